"""Token counts, mixing, toxicity and personal data."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer, models

from plateflow.llm import mixing, pii, queries, token_counts, toxicity
from tests.conftest import SF
from tests.llm.conftest import ODD

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def unigram():
    """An exact tokenizer over the same pieces and scores."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(VOCABULARY, "rb").read())
    vocab = [(p.piece, p.score if p.type == 1 else -1e12) for p in proto.pieces]
    lowest = min(p.score for p in proto.pieces if p.type == 1)
    vocab = [(t, s if s > -1e12 else lowest - 1) for t, s in vocab]
    return Tokenizer(models.Unigram(vocab, 0, True))


def test_token_counts_match_tokenizers(docs, odd, empty):
    exact = unigram()
    counter = token_counts.load(VOCABULARY)
    short = [r["text"] for r in docs.filter("n_chars < 500").limit(40).collect()] + [t for t in ODD if t and len(t) < 200 and "\x00" not in t]
    pieces = [p for t in short for p in t.split(" ") if p] + ["日本 語①テスト", "a  b   c", "\n\n", " x", "ﬁ́"]
    for text in dict.fromkeys(pieces):
        assert counter.count(text)[0] == len(exact.encode(token_counts.BLANK + text.replace(" ", token_counts.BLANK)).ids), text
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, VOCABULARY).collect()}
    assert len(got) == docs.count() and all(v > 0 for v in got.values())
    assert token_counts.count_tokens(odd, VOCABULARY).count() == odd.count() and token_counts.count_tokens(empty, VOCABULARY).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("abc▁é", max_size=14), st.lists(st.tuples(st.text("abc▁", min_size=1, max_size=4), st.integers(-6, -1)), min_size=1, max_size=12))
def test_viterbi_ties(text, vocab):
    """Many ties: against a tokenizer that relaxes edges in order of their starts, ascending, strictly."""
    pieces = {p: float(s) for p, s in vocab}
    counter = token_counts.Counter(pieces, False)
    lowest = min(pieces.values()) - 10
    best = {0: (0.0, 0, False)}
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in pieces:
                new = (best[i][0] + pieces[text[i:j]], best[i][1] + 1, False)
                if j not in best or new[0] > best[j][0]:
                    best[j] = new
        if text[i] not in pieces:
            new = (best[i][0] + lowest, best[i][1] + (not best[i][2]), True)
            if i + 1 not in best or new[0] > best[i + 1][0]:
                best[i + 1] = new
    assert counter.viterbi(text) == (best[len(text)][1], best[len(text)][0])
    if text:
        listed = Tokenizer(models.Unigram([("<u>", lowest + 10), *pieces.items()], 0, False)).encode(text)
        assert counter.viterbi(text)[0] == len(listed.ids)


def test_mixing_meets_targets(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = mixing.mix(docs, labels, F.col("quality"), {"0": 0.3, "1": 0.7}).collect()
    tokens = np.array([r["n_tokens"] for r in out], dtype=float)
    p, rate = np.array([r["p"] for r in out]), np.array([r["rate"] for r in out])
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    got = (p * (tokens * rate)[:, None]).sum(axis=0) / tokens.sum()
    assert np.abs(got - [0.3, 0.7]).max() < 1e-4
    assert tokens.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect()]
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    right = [(r["p"][1] > 0.5) == known[r["doc_id"]] for r in out if r["doc_id"] in known]
    assert np.mean(right) > 0.9
    assert mixing.mix(odd, labels, F.col("quality"), {"0": 1.0}).count() == odd.count()
    assert mixing.mix(odd, labels.limit(0), F.col("quality"), {}).count() == odd.count()
    assert mixing.mix(empty, labels, F.col("quality"), {"1": 1.0}).count() == 0


def test_domains_that_differ_in_words_only(rows):
    """Same shapes, lengths and shares of distinct words; judged on documents that are not labelled."""
    rng = np.random.default_rng(7)
    common, own = [f"{a}{b}om" for a in "bdfgk" for b in "aeiou"], {"law": ["court", "judge", "trial"], "sea": ["coast", "ships", "tidal"]}
    topics = [("law", "sea")[i % 2] for i in range(400)]
    texts = [(i, t, [*rng.choice(common, 17, replace=False), *rng.permutation(own[t])]) for i, t in enumerate(topics)]
    docs = rows("doc_id bigint, text string", [(i, " ".join(map(str, w))) for i, _, w in texts])
    labels = rows("doc_id bigint, topic string", [(i, t) for i, t, _ in texts[:200]])
    out = {r["doc_id"]: r for r in mixing.mix(docs, labels, F.col("topic"), {"law": 0.8, "sea": 0.2}).collect()}
    assert all((out[i]["p"][0] > 0.9) == (t == "law") and (out[i]["p"][1] > 0.9) == (t == "sea") for i, t, _ in texts)
    assert abs(sum(out[i]["rate"] for i, t, _ in texts if t == "law") / sum(r["rate"] for r in out.values()) - 0.8) < 0.01


def test_rates_solve_the_least_squares(rows):
    """Against projected gradient on one machine, with targets that force rates to zero."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4, 0.4, 0.4], 60)
    t = rng.integers(1, 50, 60)
    members = rows("doc_id bigint, n_tokens bigint, p array<double>", [(i, int(t[i]), [float(x) for x in p[i]]) for i in range(60)])
    for share in ([0.5, 0.3, 0.2], [0.9, 0.05, 0.05]):
        got = mixing.fit_rates(members, share, 1.0).orderBy("doc_id").collect()
        rate = np.array([r["rate"] for r in got])
        r, a = np.ones(60), p * t[:, None] / t.sum()
        for _ in range(20000):
            r = np.maximum(0, r - p @ (a.T @ r - share))
        loss = lambda x: float(((a.T @ x - share) ** 2).sum())
        assert rate.min() >= 0 and loss(rate) <= loss(r) + 3e-4


def test_rates_of_at_least_one_meet_the_shares(rows):
    """Soft memberships; the shares of the last case are met exactly only by dropping a document."""
    rng = np.random.default_rng(6)
    cases = [(rng.dirichlet([0.4] * 3, 60), [0.6, 0.25, 0.15], 1e-4), (rng.dirichlet([2, 2], 60), [0.35, 0.65], 1e-4), (np.array([[0.9, 0.1], [0.1, 0.9]]), [0.1, 0.9], 0.01)]
    for p, share, off in cases:
        members = rows("doc_id bigint, n_tokens bigint, p array<double>", [(i, 10 + i % 7, [float(x) for x in r]) for i, r in enumerate(p)] + [(-1, 0, [1.0 / len(share)] * len(share))])
        got = mixing.fit_rates(members, share).filter("doc_id >= 0").collect()
        total = sum(np.array(r["p"]) * r["rate"] * r["n_tokens"] for r in got)
        assert min(r["rate"] for r in got) >= 1 and np.abs(total / total.sum() - share).max() < off


def test_rates_of_alike_memberships_and_of_many_domains(rows):
    """Posteriors that hardly differ, and more domains than 32."""
    rng = np.random.default_rng(8)
    alike = 0.5 + rng.uniform(-0.004, 0.004, 80)
    for p, share in ((np.c_[alike, 1 - alike], [0.502, 0.498]), (rng.dirichlet([0.2] * 40, 200), rng.dirichlet([40.0] * 40).tolist())):
        members = rows("doc_id bigint, n_tokens bigint, p array<double>", [(i, 10 + i % 7, [float(x) for x in r]) for i, r in enumerate(p)])
        got = mixing.fit_rates(members, share, 1.0).collect()
        total = sum(np.array(r["p"]) * r["rate"] * r["n_tokens"] for r in got) / sum(r["n_tokens"] for r in got)
        assert min(r["rate"] for r in got) >= 0 and np.abs(total - share).max() < 1e-6


def test_missed_shares_are_told(rows):
    members = rows("doc_id bigint, n_tokens bigint, p array<double>", [(0, 10, [0.6, 0.4]), (1, 10, [0.5, 0.5])])
    with pytest.warns(UserWarning, match="miss the targets"):
        mixing.fit_rates(members, [0.1, 0.9], 1.0)


def test_forty_domains(rows):
    docs = rows("doc_id bigint, text string", [(i, f"topic{'abcdefgh'[i % 8]}{'vwxyz'[i % 40 // 8]} and the rest") for i in range(400)])
    labels = rows("doc_id bigint, source string", [(i, f"{i % 40:02d}") for i in range(400)])
    out = mixing.mix(docs, labels, F.col("source"), {f"{k:02d}": 40.0 + k for k in range(40)}).collect()
    total = sum(np.array(r["p"]) * r["rate"] * r["n_tokens"] for r in out) / sum(r["n_tokens"] for r in out)
    assert all(int(np.argmax(r["p"])) == r["doc_id"] % 40 for r in out)
    assert np.abs(total - (40 + np.arange(40)) / 2380).max() < 1e-4


def test_apply_rates(rows):
    docs = rows("doc_id bigint, text string, lang string", [(i, "t", "en") for i in range(400)])
    rates = rows("doc_id bigint, rate double", [(i, [0.0, 1.0, 2.5, 0.25][i % 4]) for i in range(400)])
    got = [r["doc_id"] % 4 for r in mixing.apply_rates(docs, rates).collect()]
    assert got.count(0) == 0 and got.count(1) == 100 and 220 < got.count(2) < 280 and 10 < got.count(3) < 45


def test_grammar():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {"lowei": 7.0})
    at = {name: i for i, name in enumerate(toxicity.EVENTS)}
    for text, event, weight in (
        ("you are an Idiot!", "addressed", 5), ("what an idiot.", "insulted", 5), ("she is not an idiot", "addressed", 5), ("not an idiot", "negated", 5),
        ("they wrote idiot", "reported", 5), ("I will kill you", "threatened", 1), ("ein Loweiisch", "insulted", 7), ("kill time. you", "violent", 1),
    ):
        got = toxicity.measure(text, lexicon)
        assert got[at[event]] == weight or event == "addressed", (text, got)
        assert got[:-1].sum() == weight
    assert not toxicity.measure("you are not kind, he said", lexicon).any() and not toxicity.measure("", lexicon).any()


def test_toxicity_held_out(spark, odd, empty):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left_semi"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [d for d in got if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    hit = sum(got[d]["predicted"] and truth[d] for d in held)
    assert hit >= 0.85 * sum(truth[d] for d in held)
    assert sum(got[d]["predicted"] and not truth[d] for d in held) <= 0.02 * len(held)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, model).collect())
    none = toxicity.train(empty, labels.limit(0))
    assert toxicity.score(odd, none).count() == odd.count() and toxicity.score(empty, none).count() == 0


def plain_spans(text):
    text = text or ""
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]

    def luhn(m):
        d = [int(c) for c in re.sub("[^0-9]", "", m)][::-1]
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0

    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": ip,
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if luhn(m[0])],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15],
    }


@settings(max_examples=400, deadline=None)
@given(st.text("a@.1 -+(9_é255", max_size=60))
def test_base_spans_match_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_personal_data(spark, docs, odd, empty):
    for source in (docs, odd):
        for r in pii.find_personal(source.withColumn("_id", F.col("doc_id"))).join(source.select("doc_id", "text"), "doc_id").collect():
            want = plain_spans(r["text"])
            base = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
            assert [r[f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS]
            assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base)
        assert pii.find_personal(source).count() == source.count()
    assert pii.find_personal(empty).count() == 0


def test_disclosing_terms(rows):
    """A code name that only ever stands beside one address gives it away; words beside a copied address do not."""
    filler = ["alpha beta gamma delta", "one two three four", "red green blue black", "north south east west"]
    data = [(i, f"{filler[i]} write to blackbird at jo@site.org about {filler[3 - i]}") for i in range(4)]
    data += [(10 + i, "the same zebra text every time max@other.org with the same words") for i in range(9)]
    data += [(100 + i, f"plain number{i} write to somebody at about home") for i in range(60)]
    data += [(900, "Blackbird sings")]
    docs = rows("doc_id bigint, text string", data)
    found = pii.find_personal(docs)
    spans = {r["doc_id"]: r["spans"] for r in found.collect()}
    text = dict(data)
    added = {d: [text[d][int(a) : int(b)] for k, a, b in (x.split(":") for x in s.split(",") if x) if k in pii.ADDED] for d, s in spans.items()}
    assert added[900] == ["Blackbird"] and added[0] == ["blackbird"] and not added[10] and not added[100]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, found).collect()}
    assert "jo@" not in clean[0] and "lackbird" not in clean[0] + clean[900] and "[EMAIL]" in clean[0] and clean[100] == text[100]
