"""Each operator against brute force or an exact round trip, with nulls, empty and odd texts, ties, repeated rows and other columns."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import bpe, chat, decontaminate, lines, ngram_join, quality, simhash, substrings, token_files, warc
from rasterloom.llm.common import stash

from ..conftest import SF

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", "   ", None, "a", "one two", "One TWO", "x" * 3000, "\n\n", "éa ñandú ß 日本", "w " * 700]


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, "src", 7, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, gone string")


def corpus(seed=1, groups=6, copies=8):
    """Groups of edited copies of texts, and odd ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    out = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([12, 40, 160]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
    r.shuffle(out)
    return out + ODD


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, ["x"]).where("false")


# 1 -------------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip_with_magic_in_payloads(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "b" * 1500
    rows = [(1, "http://a", None), (2, None, fake * 3), (3, "u\r\nX: y", "short"), (4, "u", big), (5, "u", big), (6, "u", "short"), (None, "u", big), (7, "u", fake + big + "é"), (5, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.read(spark, str(tmp_path / "w")).collect())
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html == big and i != 5
        want.append((i or -1, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 5 if again else 0))
    assert got == sorted(want)
    payload = {r.page_id: r.payload for r in warc.read(spark, str(tmp_path / "w"), payload=True).where("record_type = 'response'").collect()}
    assert bytes(payload[2]).decode() == fake * 3
    warc.write(pages.where("false"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_chain_rejects_what_no_chain_reaches(spark, tmp_path):
    at, after = np.array([0, 10, 20, 30, 50]), np.array([20, 30, 50, 99, 60])
    assert warc.chain(at, after).tolist() == [0, 2, 4]
    (tmp_path / "cut.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")
    with pytest.raises(Exception, match="does not end"):
        warc.read(spark, str(tmp_path / "cut.warc")).collect()


def test_warc_is_read_in_byte_ranges(spark, tmp_path):
    """Ranges end anywhere: in headers, payloads, version lines, real and false."""
    r = random.Random(1)
    fake = "WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    rows = [(i, r.choice([None, "http://x/WARC/1.1", "u" * 90]), "".join(r.choice(["x" * r.randrange(40), fake, "WARC/1.1\r\n", "é\r\n\r\n"]) for _ in range(r.randrange(9)))) for i in range(150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    warc.write(pages, str(tmp_path / "w"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in was:
            spark.conf.set(k, "997")
        assert spark.read.option("lineSep", "WARC/1.1\r\n").text(str(tmp_path / "w")).rdd.getNumPartitions() > 20
        got = {x.page_id: (x.url, x.payload_bytes, x.payload_digest) for x in warc.read(spark, str(tmp_path / "w")).collect()}
        assert {x.page_id: x.payload.decode() for x in warc.read(spark, str(tmp_path / "w"), payload=True).collect()} == {i: h for i, _, h in rows}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {i: (u, len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for i, u, h in rows}


def test_warc_of_many_groups_of_copies(spark, monkeypatch):
    rows = [(i, "u", f"{i % 7} " * 600) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_digest", F.lit("clash"))
    plain = sorted(warc.typed(pages).select("page_id", "record_type", "refers_to").collect())
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 1)
    assert sorted(warc.typed(pages).select("page_id", "record_type", "refers_to").collect()) == plain
    assert sum(x.record_type == "response" for x in plain) == 7


def test_warc_reads_headers_of_any_length(spark, tmp_path):
    url = "http://x/" + "u" * 200_000
    pages = spark.createDataFrame([(1, "http://a/", "one"), (2, url, "two"), (3, "http://b/", "three")], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    rows = warc.read(spark, str(tmp_path / "w"), payload=True).collect()
    assert sorted((r.page_id, r.url, r.payload.decode()) for r in rows) == [(1, "http://a/", "one"), (2, url, "two"), (3, "http://b/", "three")]


# 2 -------------------------------------------------------------------------------------------------------------------------


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_against_brute_force(spark):
    texts = ["a b c d e\nx y z w v", "a b  c\td e ", "q b c d e", "a b c d", "b c d e z", "a b c d e f\n\nfoo", None, "", " a b c d e f g h\r\na b c d e f g h", "l m n o p q", "l m n o p q r", "m n o p q r s t", "m n o p X r s t u", "m n o p q r s t u", "a b c d e"]
    df = docs_of(spark, texts)
    split = [(d, i, [w for w in re.split(r"[ \t\x0b\f\r]+", x) if w]) for d, t in enumerate(texts) if t is not None for i, x in enumerate(t.split("\n"))]
    split = [x for x in split if len(x[2]) >= 5]
    want = {(d, i) for d, i, w in split if any((e, j) < (d, i) and _edits(w, v) <= 1 for e, j, v in split)}
    assert {(r.doc_id, i) for r in lines.removed(df).collect() for i in r.gone} == want
    kept = {r.doc_id: r for r in lines.dedup(df).collect()}
    assert lines.dedup(df).columns == df.columns
    assert 14 not in kept and kept[7].text == "" and kept[6].text is None and kept[0].text == texts[0]
    assert kept[5].text == "\nfoo" and kept[5].n_chars == 4 and kept[5].gone == "clash"
    d = {r.doc_id: (r.n_lines, r.n_removed) for r in lines.digests(df).collect()}
    assert d[8] == (2, 1) and d[6] == (1, 0) and len(d) == len(texts)


def test_line_dedup_removes_equal_short_lines(spark):
    df = docs_of(spark, ["a b\n\nfoo", "foo\nbar", " a  b\n\nbaz", "foo", "a c", "a b c d\na b c d"])
    assert {(r.doc_id, i) for r in lines.removed(df).collect() for i in r.gone} == {(1, 0), (2, 0), (3, 0), (5, 1)}
    assert {r.doc_id: r.text for r in lines.dedup(df).collect()} == {0: "a b\n\nfoo", 1: "bar", 2: "\nbaz", 4: "a c", 5: "a b c d"}
    assert {r.doc_id: r.n_removed for r in lines.digests(df).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 1}


def _near_lines(split):
    """Places of lines (place, words), in order, that go: all pairs of lines, but for those of which the numbers of words tell that they are too far."""
    entries = {}
    for at, w in split:
        entries.setdefault(tuple(w), at)
    near, counts = set(), {w: Counter(w) for w in entries}
    for w, at in entries.items():
        for v, other in entries.items():
            bound = max(len(w), len(v)) // 5
            if other < at and min(len(w), len(v)) >= 5 and abs(len(w) - len(v)) <= bound:
                if (counts[w] - counts[v]).total() <= bound and (counts[v] - counts[w]).total() <= bound and _edits(w, v) <= bound:
                    near.add(w)
                    break
    return {at for at, w in split if tuple(w) in near or entries[tuple(w)] < at}


def test_line_dedup_misses_no_line_within_the_bound(spark):
    """Edits in all parts of a line, lines that are near another than the earliest one, and few different words."""
    base = [f"w{i}" for i in range(20)]
    edit = lambda w, *at: [f"{x}-{len(at)}" if i in at else x for i, x in enumerate(w)]
    near = edit(base, 2, 8, 14, 17)
    far = edit(near, 0, 5, 11, 19)
    few = "a b a b a b a b a b".split()
    texts = [" ".join(x) for x in (base, near, far, base[:12], edit(base[:12], 1, 9), few, edit(few, 1, 8), few + ["c", "d"], base[3:11], edit(base[3:11], 2, 5) + ["x", "y"])]
    assert {x.doc_id for x in lines.removed(docs_of(spark, texts)).collect()} == {1, 2, 4, 6, 7}


def test_line_dedup_bound_grows_with_the_line(spark):
    r = random.Random(5)
    voc = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randrange(1, 9))) for _ in range(600)]
    texts = []
    for n in [8, 9, 10, 11, 12, 14, 15, 18, 20, 25, 32, 40, 61, 80, 130, 300] * 3:
        base = [r.choice(voc) for _ in range(n)]
        for share in (0, 0.03, 0.1, 0.19, 0.21, 0.3):
            w = list(base)
            for _ in range(round(n * share)):
                at, kind = r.randrange(len(w)), r.randrange(3)
                w[at : at + (kind > 0)] = [r.choice(voc)] * (kind < 2)
            texts.append(" ".join(w))
    texts += ["the " * 30, "the " * 27 + "a b c", "the " * 20, "p q " * 10, "q p " * 10, "日本 " * 11 + "x", "日本 " * 12]
    r.shuffle(texts)
    df = docs_of(spark, ["\n".join(texts[i : i + 3]) for i in range(0, len(texts), 3)])
    want = _near_lines([((i // 3, i % 3), t.split()) for i, t in enumerate(texts)])
    assert len(want) > 100
    assert {(x.doc_id, i) for x in lines.removed(df).collect() for i in x.gone} == want


def test_line_dedup_finds_all_lines_of_few_edits(spark):
    """One edit of any kind, or changed words of which there are fewer than blocks."""
    r = random.Random(6)
    voc = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randrange(3, 9))) for _ in range(3000)]
    texts = []
    for n in (6, 7, 10, 11, 12, 13, 17, 23, 40, 75, 150, 400):
        base = [r.choice(voc) for _ in range(n)]
        texts.append(" ".join(base))
        for kind in (0, 1, 2) * 2:
            w = list(base)
            at = r.randrange(len(w))
            w[at : at + (kind > 0)] = [r.choice(voc)] * (kind < 2)
            texts.append(" ".join(w))
        w = list(base)
        for at in r.sample(range(n), max(1, (n - 6) // 12)):
            w[at] = r.choice(voc)
        texts.append(" ".join(w))
    assert {x.doc_id for x in lines.removed(docs_of(spark, texts)).collect()} == {i for i in range(len(texts)) if i % 8}


def test_line_dedup_compares_few_lines_that_are_not_near(spark, monkeypatch):
    """Lines of the same words in other orders."""
    pairs, real = [], lines.stash

    def stash(df, name):
        out = real(df, name)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(lines, "stash", stash)
    r, words = random.Random(7), [f"w{i}" for i in range(300)]
    texts = [" ".join(r.sample(words, 300)) for _ in range(40)]
    assert {x.doc_id for x in lines.removed(docs_of(spark, [*texts, texts[0] + " more"])).collect()} == {40}
    assert sum(pairs) <= 2 * len(texts)


def test_line_dedup_meets_few_lines_that_share_a_passage(spark, monkeypatch):
    """Lines of other words around a passage of long ones, and one that is near the last of them."""
    made, real = [], lines.stash

    def stash(df, name):
        out = real(df, name)
        if name in ("met", "pairs"):
            made.append(out.count())
        return out

    monkeypatch.setattr(lines, "stash", stash)
    passage = [f"averylongword{i}" for i in range(7)]
    texts = [" ".join([f"a{i}-{j}" for j in range(12)] + passage + [f"b{i}-{j}" for j in range(12)]) for i in range(40)]
    assert {x.doc_id for x in lines.removed(docs_of(spark, [*texts, texts[-1] + " more"])).collect()} == {40}
    assert sum(made) <= 2 * len(texts)


@pytest.mark.parametrize("rare", [0, 2, 40])
def test_line_dedup_misses_no_line_of_frequent_words(spark, monkeypatch, rare):
    """Few words are rare enough to be keys by themselves, so pairs of frequent neighbours are; some lines have both kinds, or no rare word at all."""
    monkeypatch.setattr(lines, "RARE", rare)
    r = random.Random(8)
    voc = [f"w{i}" for i in range(30)]
    word = lambda: r.choice(voc) if r.random() < 0.8 else f"r{r.randrange(60)}"
    texts = []
    for n in [5, 6, 7, 8, 9, 10, 13, 14, 15, 19, 20, 24, 29, 34, 44, 60, 120, 188, 191, 193, 199, 204, 236, 241] * 2:
        base = [word() for _ in range(n)]
        for share in (0, 0.1, 0.2, 0.2, 0.2, 0.25):
            w = list(base)
            for _ in range(int((n + 1) * share)):
                at, kind = r.randrange(len(w)), r.randrange(3)
                w[at : at + (kind > 0)] = [word()] * (kind < 2)
            texts.append(" ".join(w))
    r.shuffle(texts)
    want = _near_lines([((i, 0), t.split()) for i, t in enumerate(texts)])
    assert len(want) > 80
    assert {(x.doc_id, i) for x in lines.removed(docs_of(spark, texts)).collect() for i in x.gone} == want


def test_line_dedup_gives_frequent_words_to_no_key(spark, monkeypatch):
    """Lines of frequent words in any order: few share a pair of neighbours, all would share single words."""
    monkeypatch.setattr(lines, "RARE", 100)
    r, words = random.Random(9), [f"w{i}" for i in range(400)]
    texts = [" ".join(r.sample(words, 40)) for _ in range(3000)]
    keys = lines._keyed(docs_of(spark, texts)).select(F.explode("keys").alias("key"), "n")
    seen = [x["count"] for x in keys.groupBy("key").count().collect()]
    assert max(seen) <= 12 and sum(seen) <= 17 * len(texts)


def test_line_dedup_keeps_all_columns_and_takes_long_lines(spark):
    t = " ".join(f"word{i}" for i in range(20_000))
    rows = [(1, t, "a", "b", "c", "d", "e"), (2, t + " more", "a", "b", "c", "d", "e"), (2, "x y", "p", "q", "r", "s", "t"), (2, "x y", "p", "q", "r", "s", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, gone_own string, gone_id string, Gone_text string, `a.b` string")
    got = lines.dedup(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    assert sorted(tuple(x)[2:] + (tuple(x)[1][:3],) for x in got.collect()) == [("a", "b", "c", "d", "e", "wor"), ("p", "q", "r", "s", "t", "x y"), ("p", "q", "r", "s", "t", "x y")]


def test_line_dedup_without_rows_or_ids(spark, empty):
    assert lines.dedup(empty).count() == 0
    df = docs_of(spark, ["a b c d e", "a b c d e"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert lines.dedup(df).count() == 2


# 3 -------------------------------------------------------------------------------------------------------------------------


def _substrings(texts, window):
    first, words = {}, {}
    for d, t in enumerate(texts):
        words[d] = WORD.findall(t or "")
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_substring_dedup_against_brute_force(spark):
    r = random.Random(3)
    voc = [f"v{i}" for i in range(300)]
    shared = [[r.choice(voc) for _ in range(n)] for n in (50, 51, 90, 200)]
    texts = []
    for _ in range(40):
        w = []
        for _ in range(r.randrange(4)):
            s = r.choice(shared)
            a = r.randrange(3)
            w += [r.choice(voc) for _ in range(r.randrange(40))] + s[a : len(s) - r.randrange(3)]
        texts.append("  ".join(w) + "\n")
    texts += [*ODD, "on " * 300, "on " * 120, texts[0], texts[1]]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.digests(docs_of(spark, texts)).collect()}
    assert got == _substrings(texts, 50)
    assert sum(v[1] for v in got.values()) > 500


def test_substring_dedup_of_equal_ids_and_null_ids(spark, empty):
    t = " ".join(f"a{i}" for i in range(60))
    rows = [(1, t), (1, t), (1, "z " + t), (None, t), (2, t)]
    got = [(x.doc_id, x.n_removed) for x in substrings.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (1, 0), (1, 0), (None, 0), (2, 60)], key=str)
    assert substrings.digests(empty).count() == 0


# 4 -------------------------------------------------------------------------------------------------------------------------


def _components(texts, n, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOW))
        m = min(n, len(w))
        sets.append({tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set())
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            k = len(s & sets[j])
            if k and 100 * k >= percent * len(s | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_against_brute_force(spark, n, percent):
    texts = corpus(n)
    df = docs_of(spark, texts)
    want = _components(texts, n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(df, n=n, percent=percent).collect()} == want
    kept = ngram_join.one_of_each(df, n=n, percent=percent)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in want.items() if c == d}


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(0)
    for size in (5, 9, 14, 30, 77, 300, 1500):
        for percent in (80, 90):
            most = (100 - percent) * size // (100 + percent)
            for _ in range(20):
                x = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
                y = np.unique(np.concatenate([x[most:], r.integers(0, 1 << 63, most, dtype=np.uint64)]))
                both = len(np.intersect1d(x, y))
                if most and 100 * both >= percent * (len(x) + len(y) - both):
                    assert np.intersect1d(ngram_join.signatures(x, percent), ngram_join.signatures(y, percent)).size


def test_ngram_join_of_torn_groups(spark):
    """Chains of which the hub is linked with one end only, so that the rest is found in blocks."""
    r = random.Random(12)
    texts = []
    for _ in range(12):
        w = [f"x{r.randrange(10**6)}" for _ in range(90)]
        for _ in range(9):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(w))
    r.shuffle(texts)
    want = _components(texts, 3, 90)
    assert len({c for _, c in want.values()}) < 30
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.classes(docs_of(spark, texts)).collect()} == want


def test_ngram_join_refuses_what_signatures_cannot_find(spark):
    with pytest.raises(ValueError):
        ngram_join.classes(docs_of(spark, ["a b c"]), percent=50)
    df = docs_of(spark, ["a b c d e f g", "a b c d e f g"]).withColumn("_gone", F.lit("x")).withColumn("__gone", F.lit("y"))
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and [x.doc_id for x in kept.collect()] == [0]


def test_ngram_join_of_odd_rows(spark, empty):
    assert ngram_join.classes(empty).count() == 0
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (3, "q r s t u v"), (None, "a b c d e f"), (1, "q r s t u v"), (2, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(3, 4, 3), (3, 4, 3), (3, 4, 1), (None, 4, None), (1, 4, 1), (2, 0, 2)], key=str)


# 5 -------------------------------------------------------------------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_equals_the_library_and_decodes(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, "it's WE'LL don't", "a\t\t b\n\n  c ", "123456 7.8", "zz" * 900, "\x1c x\x85y　z", "<|endoftext|>", "🙂🙃 ok", *corpus(5, 2, 3)]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs_of(spark, texts), RANKS, public_tokenizers.PATTERN).collect()}
    for d, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[d] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), t
    back = bpe.decode(bpe.encode(docs_of(spark, texts), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.bytes) for r in back.collect()} == {d: (t or "").encode() for d, t in enumerate(texts)}


def test_bpe_of_long_pieces(spark):
    """Pieces without blanks, which are worked on alone."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    texts = ["".join(r.choice(letters) for _ in range(n)) for n in (255, 257, 1000, 30_000) for letters in ("ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "éüßañ")] + ["a" * 5000, "日本" * 900]
    got = {x.doc_id: (x.n_tokens, x.ids_sha256) for x in bpe.digests(docs_of(spark, texts), RANKS, public_tokenizers.PATTERN).collect()}
    for d, t in enumerate(texts):
        ids = library.encode_ordinary(t)
        assert got[d] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())


# 6 -------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["flat", "wide", "outliers", "one", "none"])
def test_blocks_round_trip(kind):
    r = np.random.default_rng(1)
    x = {"flat": np.full(500, 7), "wide": r.integers(0, 1 << 31, 1000), "outliers": np.where(r.random(1000) < 0.05, 1 << 30, r.integers(0, 50, 1000)), "one": np.array([5]), "none": np.zeros(0)}[kind].astype(np.int64)
    p = token_files.pack(x)
    assert token_files.unpack(p, 0, len(p["width"]))[: len(x)].tolist() == x.tolist()
    if kind == "outliers":
        assert p["width"].max() <= 6 and len(p["place"]) > 10
        assert token_files.unpack(p, 3, 4).tolist() == x[3 * 128 : 4 * 128].tolist()


def test_token_files_round_trip(spark, tmp_path, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, "it's don't WE'LL 'S x's. 's", "<|endoftext|> a<|EndOfText|>b", "“quoted”… …! a…!", "a1b2 3.14, $5", "́abc .́ á."]
    df = docs_of(spark, texts)
    token_files.write(df, str(tmp_path / "t"), path)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, str(tmp_path / "t")).collect())
    want, start = [], 0
    for d, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want
    token_files.write(empty, str(tmp_path / "none"), path)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_token_files_take_a_chunk_apart_once(monkeypatch):
    """Chunks and their parts are remembered, and forgetting either changes no ids."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        t = token_files.Tokens(f.read())
    want = [*t.library.encode("One, two. one, (TWO) x-1 one", add_special_tokens=False).ids, 1, 1, *t.library.encode("two.", add_special_tokens=False).ids, 1]
    texts, asked = [b"One, two. one, (TWO)\x0bx-1 one", b" \t", b"two."], []
    real = token_files._CHUNK

    class Chunk:
        def findall(self, text):
            asked.append(text)
            return real.findall(text)

    monkeypatch.setattr(token_files, "_CHUNK", Chunk())
    for _ in range(3):
        ids, count = t.encode(texts, 1)
        assert ids.tolist() == want and count.tolist()[1] == 1 and count.sum() == len(want)
    assert sorted(asked) == sorted({b"one,", b"two.", b"(two)", b"x-1", b"one"})
    for most in (4, 0):
        monkeypatch.setattr(token_files, "REMEMBER", most)
        assert t.encode(texts, 1)[0].tolist() == want


def test_token_files_merge_words_without_the_rest_of_the_library(monkeypatch):
    """Words of letters take the merges alone, each once, and get the library's ids, unless an added token could be among them."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        data = f.read()
    t, asked = token_files.Tokens(data), []
    real = t._merged
    monkeypatch.setattr(t, "_merged", lambda words: asked.extend(words) or real(words))
    for name in ("_ids", "_apart"):
        monkeypatch.setattr(t, name, lambda chunks, of=getattr(t, name): (not any(c.isalpha() for c in chunks) or pytest.fail("letters went to the library")) and of(chunks))
    text = "Straße ÉCOLE naïve übermäßig one  one, ONE.  Ærø łódź ñandú x1 \n"
    for _ in range(2):
        ids, count = t.encode([text.encode(), b"", b"<|x ONE \xc3\x89t\xc3\xa9"], 1)
        assert ids[: count[0]].tolist() == [*t.library.encode(text, add_special_tokens=False).ids, 1]
        assert ids[count[0] + 1 :].tolist() == [*t.library.encode("<|x ONE Été", add_special_tokens=False).ids, 1]
    assert sorted(asked).count(b"one") == 1 and "straße".encode() in asked
    vocabulary = json.loads(data)
    vocabulary["added_tokens"].append({"id": 60_000, "content": "one", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    assert not token_files.Tokens(json.dumps(vocabulary)).plain


def test_token_files_roll_and_give_single_documents(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(3)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "x9", "été"]) for _ in range(r.randrange(400))) for _ in range(60)]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(7, texts[7], "clash", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, content string")
    # a task's segments go to several files
    monkeypatch.setattr(token_files, "SEGMENTS", 1)
    monkeypatch.setattr(token_files, "SEGMENT", 500)
    token_files.write(df, str(tmp_path / "t"), path)
    assert len(list((tmp_path / "t").glob("part-*"))) > 4
    ids = [(d, [*library.encode(t, add_special_tokens=False).ids, 1]) for d, t, *_ in sorted(rows)]
    want, start = [], 0
    for d, x in ids:
        want.append((d, start, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
        start += len(x)
    assert sorted(tuple(x) for x in token_files.read(spark, str(tmp_path / "t")).collect()) == want
    got = [(x.doc_id, x.ids) for x in token_files.ids_of(spark, str(tmp_path / "t"), [0, 7, 33, 999]).collect()]
    assert sorted(got) == sorted((d, x) for d, x in ids if d in (0, 7, 33))


# 7 -------------------------------------------------------------------------------------------------------------------------


M64 = (1 << 64) - 1


def _mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def _voted(text):
    """The fingerprint by votes that are counted one by one."""
    words = [w.encode() for w in WORD.findall(text.translate(LOW))]
    h = [_mixed((sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w)) + len(w)) & M64) for w in words]
    terms = [(x, 1) for x in set(h)]
    for a, b, c in zip(h, h[1:], h[2:], strict=False):
        step = 0xD6E8FEB86659FD93
        terms.append((_mixed((((a * step + b) * step + c) + 3) & M64), 2))
    votes = [0] * 128
    for x, weight in terms:
        for half, y in enumerate((x, _mixed(x ^ 0x2545F4914F6CDD1D))):
            for i, byte in enumerate(y.to_bytes(8, "little")):
                for k in range(8):
                    votes[half * 64 + i * 8 + k] += weight if byte >> (7 - k) & 1 else -weight
    return f"{int(''.join('1' if v > 0 else '0' for v in votes), 2):032x}"


def test_fingerprints_against_the_next_document(spark, empty):
    texts = [*corpus(7, 3, 4), "a b c d e f " * 40, "É ß 日本 x" * 30]
    rows = [(d * 10, t) for d, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.against_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for k, (d, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (_voted(x) for x in (t, new, after))
        assert (got[d].n_chars, got[d].edited_sha256, got[d].fingerprint, got[d].edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), a, b)
        like = lambda x, y: 1 - (int(x, 16) ^ int(y, 16)).bit_count() / 128
        assert (got[d].near_edited, got[d].near_next) == (like(a, b), like(a, c))
    assert simhash.against_next(empty).count() == 0
    one = simhash.against_next(spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.doc_id is None


@pytest.mark.parametrize(("radius", "blocks"), [(4, 7), (6, 8), (0, 1), (3, 4)])
def test_all_near_fingerprints_are_found(spark, radius, blocks):
    r = random.Random(2)
    base = [0, *(r.getrandbits(128) for _ in range(5))]
    prints = list(base) * 2
    for b in base:
        for _ in range(8):
            x = b
            for k in r.sample(range(128), r.randrange(9)):
                x ^= 1 << k
            prints.append(x)
    texts = [f"{p:032x}" for p in prints]
    asked = texts[::3]
    want = {(a, b, k) for a in asked for b in texts if (k := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius}
    df = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), (-1, None)], "doc_id long, fingerprint string")
    got = [tuple(x) for x in simhash.within(df, df.where("doc_id % 3 = 0"), radius=radius, blocks=blocks).collect()]
    assert set(got) == want and len(got) == len(want)
    near = {x.doc_id: x.near_docs for x in simhash.near_counts(df, F.col("doc_id") % 3 == 0, radius=radius, blocks=blocks).collect()}
    assert near == {-1: None, **{i: sum((int(t, 16) ^ int(x, 16)).bit_count() <= radius for x in texts) - 1 if i % 3 == 0 else None for i, t in enumerate(texts)}}


def test_block_tables_are_never_broadcast(spark):
    """A query has a row for each table and task, which estimates of size leave out; within the limit or not, they are joined by a shuffle."""
    df = spark.createDataFrame([(i, f"{i:032x}") for i in range(50)], "doc_id long, fingerprint string")
    got = simhash.within(df, df.where("doc_id % 20 = 0"))
    assert got.count() == len([1 for a in (0, 20, 40) for b in range(50) if (a ^ b).bit_count() <= 6])
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_radius_must_be_less_than_blocks(spark):
    df = spark.createDataFrame([("0" * 32,)], "fingerprint string")
    with pytest.raises(ValueError):
        simhash.within(df, df, radius=8, blocks=8)


# 8 -------------------------------------------------------------------------------------------------------------------------


def test_decontamination_against_brute_force(spark, empty):
    r = random.Random(8)
    voc = [f"t{i}" for i in range(400)]
    items = [" ".join(r.choice(voc) for _ in range(n)) for n in (1, 3, 5, 9, 30, 30, 57)] + [None, "", "..."]
    texts = []
    for _ in range(60):
        w = [r.choice(voc) for _ in range(r.randrange(200))]
        it = r.choice(items[:7]).split()
        for _ in range(r.randrange(3)):
            it[r.randrange(len(it))] = "changed"
        at = r.randrange(len(w) + 1)
        texts.append(" ".join(w[:at] + [x.upper() + "," for x in it] + w[at:]))
    texts += ODD
    df, bench = docs_of(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    token = re.compile(r"[0-9a-z\x80-\U0010ffff]+")

    def shingles(t, n):
        w = token.findall((t or "").translate(LOW))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = set()
    for i, t in enumerate(items):
        n = min(5, len(token.findall((t or "").translate(LOW))))
        own = shingles(t, n) if n else set()
        for d, x in enumerate(texts):
            k = len(own & shingles(x, n)) if own else 0
            if own and 100 * k >= 80 * len(own):
                want.add((d, i, len(own), k))
    assert {tuple(x) for x in decontaminate.contained(df, bench).collect()} == want and want
    clean = decontaminate.clean(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {w[0] for w in want}
    assert decontaminate.contained(empty, bench).count() == 0 and decontaminate.contained(df, bench.where("false")).count() == 0


# 9 -------------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<</SYS>>\n", "[/INST", "", None, "a[END]b[ROLE]c[/ROLE]", "<", " [/INST]</s>"]
    r = random.Random(9)
    turns = [(c, t, r.choice(["user", "assistant", "system", "tool", None, "x[/ROLE]"]), r.choice(said)) for c in range(40) for t in range(r.randrange(1, 7))]
    turns += [(100, 0, "system", "s"), (100, 1, "user", "q"), (100, 2, "assistant", "a"), (101, 0, "user", "x" * (chat.PART + 5)), (101, 1, "assistant", "y"), (None, 0, "user", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    formatted = stash(chat.format_chats(df), "chats")
    got = {x.conv_id: x for x in chat.read_chats(formatted).collect()}
    per = {}
    for c, _, role, text in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1])):
        per.setdefault(c, []).append((role or "", text or ""))
    for c, ts in per.items():
        loss = "".join(x for role, x in ts if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(ts), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[100].valid and got[101].valid and not got[None].valid
    assert formatted.where("conv_id = 101").count() == 2
    assert chat.read_chats(chat.format_chats(df.where("false"))).count() == 0


# 10 ------------------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, empty):
    r = random.Random(10)
    good = lambda: " ".join(r.choice(["the", "river", "runs", "past", "old", "stone", "walls,", "and", "birds."]) for _ in range(r.randrange(20, 300)))
    junk = lambda: " ".join(r.choice(["BUY!!", "NOW!!", "$$$", "***", "win%%%"]) for _ in range(r.randrange(20, 300)))
    truth = [int(r.random() < 0.7) for _ in range(300)]
    df = docs_of(spark, [good() if y else junk() for y in truth])
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(truth)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    got = {x.doc_id: x for x in quality.score(df, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, x in got.items() if x.held_out} == set(held)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    assert quality.score(docs_of(spark, ODD), model).count() == len(ODD)
    assert quality.accepted(df, model).columns == df.columns
    assert quality.fit(df, labels.where("false")) is None and quality.score(df, None).where("predicted = 0").count() == 0
    assert quality.score(empty, model).count() == 0


def test_quality_of_the_supplied_labels(spark):
    """Held-out rows of the test tables, which the model has not seen: area under the curve and both kinds of error."""
    docs, labels = (spark.read.parquet(f"{SF.parent}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, quality.fit(docs, labels)).where("held_out").join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id").where("quality is not null").collect()
    good, bad = ([x.score for x in rows if x.quality == q] for q in (1, 0))
    assert len(good) > 30 and len(bad) > 5
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.97 and np.mean([b < 0.3 for b in bad]) > 0.7


def test_quality_fit_is_bounded(spark):
    """Rows that repeat a doc_id and very long texts leave the driver with a bounded sample."""
    texts = ["good words here. " * 20_000] * 40 + ["BAD!! $$$ *** " * 10] * 40
    df = spark.createDataFrame([(i % 10, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    assert quality.score(df, model).count() == 80


def test_scores_ignore_all_but_the_text(spark):
    df = docs_of(spark, corpus(11, 2, 3))
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.fit(df, labels)
    a = [r.score for r in quality.score(df, model).orderBy("doc_id").collect()]
    b = [r.score for r in quality.score(df.withColumn("source", F.lit("other")), model).orderBy("doc_id").collect()]
    assert a == b


def test_line_dedup_meets_few_lines_of_a_group_of_near_copies(spark, monkeypatch):
    """Copies whose rarest words are their own meet few of the group, and all but the first go."""
    made, real = [], lines.stash

    def stash(df, name):
        out = real(df, name)
        if name in ("met", "pairs"):
            made.append(out.count())
        return out

    monkeypatch.setattr(lines, "stash", stash)
    r = random.Random(8)
    base, texts = [f"w{i}" for i in range(60)], []
    for i in range(60):
        w = list(base)
        for at in r.sample(range(60), 5):
            w[at] = f"own{i}-{at}"
        texts.append(" ".join(w))
    assert {x.doc_id for x in lines.removed(docs_of(spark, texts)).collect()} == set(range(1, 60))
    assert sum(made) <= 10 * len(texts)


def test_line_dedup_meets_lines_by_few_of_their_keys(spark, monkeypatch):
    """Lines that share most of their keys, but are a little too far, and one that is near another than those it is first compared with."""
    made, real = [], lines.stash

    def stash(df, name):
        out = real(df, name)
        if name == "met":
            made.append(out.count())
        return out

    monkeypatch.setattr(lines, "stash", stash)
    r, texts = random.Random(9), []
    for n in (100, 230, 300):
        base = [f"w{n}-{i}" for i in range(n)]
        group = []
        for _ in range(8):
            w, at = list(base), r.randrange(3)
            for k in range(at, n, 9):
                w[k] = f"own{len(texts)}-{len(group)}-{k}"
            group.append(" ".join(w))
        texts += group
    want = _near_lines([((i, 0), t.split()) for i, t in enumerate(texts)])
    assert {(x.doc_id, i) for x in lines.removed(docs_of(spark, texts)).collect() for i in x.gone} == want
    assert 0 < sum(made) <= 60


def test_components_take_no_round_that_changes_nothing(spark, monkeypatch):
    from rasterloom.operators import components

    made, real = [], components.stash
    monkeypatch.setattr(components, "stash", lambda df, name: made.append(name) or real(df, name))
    of = lambda links: {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert of([(1, 1)]) == {} and made == ["links"]
    assert of([(2, 1), (1, 3), (3, 1), (9, 5)]) == {2: 1, 3: 1, 9: 5} and made == ["links"] * 2
    assert of([(3, 2), (2, 1)]) == {2: 1, 3: 1} and made == ["links"] * 3 + ["star"]
    r = random.Random(11)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)]
    top = {x: x for link in links for x in link}
    for _ in top:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    assert of(links) == {x: c for x, c in top.items() if x != c}
