from plateflow.fixtures import VIEWS, Fixtures, dependencies, number_lines
from tests.conftest import SF


def test_large_orders_get_the_same_line_numbers(spark):
    fx = Fixtures(spark, SF)
    plain = fx.sql(VIEWS["v_line"])
    for limit in (5, 0):
        split, small = number_lines(fx.lineitem, limit)
        assert not small and split.columns == plain.columns
        assert split.exceptAll(plain).isEmpty() and plain.exceptAll(split).isEmpty()
    assert number_lines(fx.lineitem)[1]


def test_views_come_after_the_views_they_use():
    for name, sql in VIEWS.items():
        order = dependencies(f"SELECT * FROM {name}")
        assert order[-1] == name
        assert all(order.index(used) < order.index(name) for used in dependencies(sql))


def test_many_lines_are_dealt_to_more_tasks(spark):
    """A session's few shuffle partitions do not make a task sort lines without limit."""
    fx = Fixtures(spark, SF)
    view, small = number_lines(fx.lineitem, task_rows=500)
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert small and f"{-(-fx.lineitem.count() // 500)}), REPARTITION_BY_NUM" in plan
    assert view.exceptAll(fx.sql(VIEWS["v_line"])).isEmpty() and view.count() == fx.lineitem.count()
