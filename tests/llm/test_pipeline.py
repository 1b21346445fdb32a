"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from rasterloom.checkpoints import stash
from rasterloom.llm import lines, quality

from ..conftest import SF
from .test_ops import _components, _near_lines

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stash(stage(spark, out[-1], str(SF)), name.replace(" ", "-")))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and df.dtypes == steps[0].dtypes


def test_quality_stage_takes_what_the_model_accepts(spark, steps):
    """Each document's passages weighed and scored one by one, from the model's weights."""
    model = quality.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    p, want = model.p, set()
    for d, t in texts(steps[0]).items():
        raw = (t or "").encode()
        bag = np.clip((quality.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] - model.mean) / model.scale, -8, 8)
        coded = [np.tanh(x @ p["W"] + p["b"]) for x in bag]
        weight = [float(np.exp((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"])) for h in coded]
        z = sum(w * h for w, h in zip(weight, coded, strict=True)) / sum(weight)
        if 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))) >= 0.3:
            want.add(d)
    assert set(texts(steps[1])) == want and len(want) < steps[0].count()


def test_line_stage(steps):
    """All lines against the earliest lines of their variants, one pair at a time."""
    before, after = texts(steps[1]), texts(steps[2])
    split = [((d, i), words) for d, t in sorted(before.items()) for i, x in enumerate(t.split("\n")) if (words := [w for w in re.split(r"[ \t\x0b\f\r]+", x) if w])]
    gone = _near_lines(split)
    want = {}
    for d, t in before.items():
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        if kept == t or WORD.search(kept):
            want[d] = kept
    assert after == want and len(gone) > 50
    assert {r.doc_id: r.n_chars for r in steps[2].collect()} == {d: len(t) for d, t in want.items()}


def test_line_stage_misses_no_line_within_the_bound(spark):
    """Four words of twenty that are changed in all parts of the line."""
    words = [f"w{i}" for i in range(20)]
    rows = [(0, " ".join(words)), (1, " ".join("x" if i in (2, 8, 14, 17) else w for i, w in enumerate(words)) + "\nother words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert texts(corpus_pipeline.dedup_lines(spark, docs, str(SF))) == {0: rows[0][1], 1: "other words"}


def test_document_stage_keeps_one_of_each_group(steps):
    """All pairs of documents by their five-word shingles."""
    before, after = texts(steps[2]), texts(steps[3])
    ids = sorted(before)
    of = _components([before[d] for d in ids], 5, 80)
    assert set(after) == {ids[k] for k, (_, c) in of.items() if c == k}


def test_benchmark_stage(spark, steps):
    """All documents against all items."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(t, n):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate(low))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, len(w)

    items = []
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        n = min(5, shingles(r.text, 1)[1])
        if n:
            items.append((n, shingles(r.text, n)[0]))
    want = set()
    for d, t in texts(steps[3]).items():
        own = {n: shingles(t, n)[0] for n in {n for n, _ in items}}
        if all(100 * len(s & own[n]) < 80 * len(s) for n, s in items):
            want.add(d)
    assert set(texts(steps[4])) == want


def test_last_stage_is_what_the_library_gives_and_decodes_to_its_input(steps):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = {r.doc_id: r for r in steps[5].collect()}
    assert set(last) == set(texts(steps[4]))
    for d, t in texts(steps[4]).items():
        assert np.frombuffer(last[d].ids, "<u4").tolist() == library.encode_ordinary(t)
        assert last[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_of_no_documents(spark, steps):
    docs = steps[0].where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, str(SF)), "none")
        assert docs.count() == 0


def test_tables_of_other_queries_outlive_the_pipeline(spark, steps):
    """A result that has not been read yet when a pipeline runs."""
    kept = lines.dedup(steps[1])
    corpus_pipeline.keep_quality(spark, steps[0], str(SF))
    corpus_pipeline.dedup_lines(spark, steps[1], str(SF))
    assert kept.count() == steps[2].count()
