"""Pluggable recognition: any callable that turns one image into detections (``mapInArrow``).

No model ships with the library. A provider is built once per Python worker, on first use, and is
called for every image of the partition; a failure is recorded as a failed row.
"""

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plateflow import dims

#: bytes, path -> list of detections (dicts of the result schema)
Provider = Callable[[bytes, str], list[dict]]

RESULT_DDL = "path string, provider string, is_mock boolean, status string, error_message string, detections string"
#: Results handed back at a time.
OUT_ROWS = 1024
_FACTORIES: dict[str, Callable[[], Provider]] = {}


def register_provider(name: str, factory: Callable[[], Provider]) -> None:
    _FACTORIES[name] = factory


def _mock() -> Provider:
    return lambda content, path: []


register_provider("mock", _mock)


def recognise(images: DataFrame, provider: str = "mock", factory: Callable[[], Provider] | None = None) -> DataFrame:
    """Recognition result per image (path, content): completed with its detections as JSON, or
    failed with a reason. An unknown provider name fails before anything runs."""
    build = factory or _FACTORIES.get(provider)
    if build is None:
        raise ValueError(f"unknown provider: {provider}")
    mock = provider == "mock"

    schema = pa.schema([("path", pa.string()), ("provider", pa.string()), ("is_mock", pa.bool_()), ("status", pa.string()), ("error_message", pa.string()), ("detections", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recogniser = None
        for batch in batches:
            # One image at a time leaves the batch; its content is never there a second time for all rows.
            for start in range(0, batch.num_rows, OUT_ROWS):
                rows = []
                for i in range(start, min(start + OUT_ROWS, batch.num_rows)):
                    path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    try:
                        recogniser = recogniser or build()
                        found = json.dumps(recogniser(content, path))
                        rows.append((path, provider, mock, "completed", None, found))
                    except TimeoutError:
                        rows.append((path, provider, mock, "failed", dims.DEADLINE_EXCEEDED, None))
                    except Exception as error:
                        # Only the kind of error is kept: messages may quote paths or plates.
                        rows.append((path, provider, mock, "failed", f"{dims.PROCESSING_FAILED} ({type(error).__name__})", None))
                yield pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows), schema)], schema=schema)

    return images.select("path", "content").mapInArrow(run, RESULT_DDL)
