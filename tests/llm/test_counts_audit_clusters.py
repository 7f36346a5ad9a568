"""Token counts, the source audit and centroid clustering: brute force, hard rows, and what each keeps between runs."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_edge_cases import CLASH, LONG, ROWS, SCHEMA
from tokenizers import Tokenizer

from moundworks.llm import clustering, source_audit, token_counts

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})


# Token counts


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(token_counts.path())


def plain(model, text):
    return len(model.encode(text or "", add_special_tokens=False).ids)


def test_counts_against_the_library(spark, model):
    rows = {r["doc_id"]: r for r in token_counts.op11_token_counts(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n, found = plain(model, d["text"]), rows[d["doc_id"]]
        assert (found["n_bytes"], found["n_tokens"], found["over_limit"]) == (len((d["text"] or "").encode()), n, n > 2048)


ODD = ["a", "B", "'s", "ST", " ", "\n", "\x0b", "\u0085", "　", "́", "̌", "J", "H̱", "İ", "ß", "Σ", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "가", "7", ".", "\x1c", "​"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=20).map("".join))
def test_the_normal_form_keeps_counts(text):
    model = Tokenizer.from_file(token_counts.path()) if not hasattr(test_the_normal_form_keeps_counts, "model") else test_the_normal_form_keeps_counts.model
    test_the_normal_form_keeps_counts.model = model
    form = token_counts.normal(text.encode(), True)
    assert plain(model, form.decode()) == plain(model, text) == token_counts.Chunks(lambda some: [plain(model, t) for t in some])([form])[0]


def test_hard_texts(docs, model):
    rows = token_counts.count_tokens(docs).collect()
    assert len(rows) == len(ROWS) and {"lang", "source", "n_chars"} <= set(rows[0].asDict()) and "text" not in rows[0]
    texts = {k: t for k, t, *_ in ROWS}
    for r in rows:
        assert (r["n_bytes"], r["n_tokens"]) == (len((texts[r["doc_id"]] or "").encode()), plain(model, texts[r["doc_id"]]))
        assert all(r[c] == "clash" for c in CLASH if c not in token_counts.OUT)
    assert token_counts.count_tokens(docs.where("false")).collect() == []


def test_only_distinct_misses_are_encoded(spark, monkeypatch, tmp_path):
    cache, sent = f"file://{tmp_path}/cache", []
    encode = token_counts.counted
    monkeypatch.setattr(token_counts, "counted", lambda rows, file: (sent.append(sorted(r["text"] for r in rows.collect())), encode(rows, file))[1])
    count = lambda *texts, **more: [r["n_tokens"] for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), cache=cache, **more).orderBy("doc_id").collect()]
    assert count("One  two", "one two", "three", None) == [2, 2, 1, 0]
    assert sent == [["", "one two", "three"]]
    assert count("ONE\ttwo", "three", few=0) == [2, 1] and len(sent) == 1
    assert count("one two", "Four four", "four four", few=0) == [2, 2, 2] and sent[1:] == [["four four"]]  # digests sent by a shuffle
    other = token_counts.path("byte_bpe_50k.json")
    assert count("One  two", "one two", file=other) == [plain(Tokenizer.from_file(other), t) for t in ("One  two", "one two")]
    assert sent[2:] == [["One  two", "one two"]]  # another version, and white space counts
    assert spark.read.parquet(cache).groupBy("tokenizer").count().count() == 2
    pieces = token_counts.path("piece_bpe_32k.model")
    assert count("One  two", LONG, file=pieces)[0] == token_counts.encoder(pieces)(["One  two"])[0]


def test_another_tokenizer_on_a_worker_is_an_error(spark, tmp_path):
    file = tmp_path / "t.json"
    file.write_text(open(token_counts.path(), encoding="utf-8").read())
    rows = token_counts.counted(spark.createDataFrame([(b"x", "some text")], "digest binary, text string"), str(file))
    file.write_text(open(token_counts.path("byte_bpe_50k.json"), encoding="utf-8").read())
    with pytest.raises(Exception, match="another tokenizer"):
        rows.collect()


def test_repeated_cache_rows_are_harmless(spark, tmp_path):
    cache, docs = f"file://{tmp_path}/cache", spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    token_counts.count_tokens(docs, cache=cache)
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert token_counts.count_tokens(docs, cache=cache).count() == 2


# The audit


def brute_audit(rows, least, ranks):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, whole, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower)))
        groups[lang or "", source or ""].update(terms)
        whole[lang or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for (lang, source), mine in groups.items():
        kept = [t for t in whole[lang] if seen[lang][t] >= least]
        p = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))
        f = lambda a, b: (a - b) ** 2 // b
        own, base = p(mine), p(whole[lang])
        pairs = [(s, sum(f(own[t], theirs[t]) for t in kept)) for (other, s), c in groups.items() if other == lang and s != source for theirs in [p(c)]]
        terms = [(t, f(own[t], base[t])) for t in kept if mine[t] and own[t] > base[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
            found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, r + 1) for r, (item, value) in enumerate(found)]
    return sorted(out)


def audited(rows, spark, **more):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit("x"), "slice": F.lit("x"), "n": F.lit("x")})
    return sorted(tuple(r) for r in source_audit.audit(docs.select("lang", "source", "text", "term", "slice", "n"), **more).collect())


@pytest.mark.parametrize("size", [1, 60, 16 << 20])
def test_audit_against_brute_force(spark, size):
    rng = random.Random(4)
    words = ["The", "the,", "don't", "a-a", "É", "été", "x1y", "42", "--", "naïve b", "z" * 300] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "S2", None]), " \n".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 80])))) for _ in range(120)]
    rows += [("fr", "s0", None), ("fr", "s1", "17"), ("it", "s0", "ciao"), rows[-1]]
    assert audited(rows, spark, ranks=5, size=size) == brute_audit(rows, 3, 5)


def test_audit_of_few_parts_and_no_rows(spark, docs):
    rows = [("en", f"s{k % 3}", f"one two {'three' * (k % 2)} {k}") for k in range(30)]
    assert audited(rows, spark, least=2, ranks=200) == brute_audit(rows, 2, 200)
    assert audited([], spark) == []
    assert source_audit.audit(docs).count() > 0


def test_pieces_of_long_texts():
    text = b"ab cd\nefghijkl " * 50 + b"x" * 100 + b" y"
    for most in (1, 5, 64, 10_000):
        cut = list(source_audit.pieces(text, most))
        assert b"".join(cut) == text and [w for p in cut for w in p.split()] == text.split()


def test_a_long_text_in_pieces_counts_once():
    text = " ".join(f"w{k % 700}" for k in range(5000)).encode()
    one, many = source_audit.Matrix(), source_audit.Matrix()
    one.add(0, [text])
    for p in source_audit.pieces(text, 300):
        many.add(0, [p])
    as_counts = lambda m: (lambda e, i, c, w: (e.tolist(), dict(zip(w.take(pa.array(i)).to_pylist(), c.tolist(), strict=True))))(*m.arrays(1))
    assert as_counts(one) == as_counts(many) and len(as_counts(one)[1]) == 700


# Clusters


def floor_of(x):
    return clustering.whole(x)


def brute_clusters(rows, k, rounds):
    kept = [(i, [floor_of(x) for x in v], v) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:k]
    centres = [v for _, v, _ in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v, _ in kept]
        for j in range(len(centres)):
            members = [v for (_, v, _), o in zip(kept, own, strict=True) if o == j]
            if members:
                centres[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [(i, *nearest(v)) for i, v, _ in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    fits = lambda x: x if x < 1 << 63 else None
    digest = lambda j: hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()
    whole = sum(inertia.values()) if all(d < 1 << 63 for _, d, _ in found) else 1 << 63
    return sorted(((str(i), j, fits(d), fits(inertia[j]) if all(fits(e) is not None for _, e, o in found if o == j) else None, fits(whole), digest(j)) for i, d, j in found), key=str)


@pytest.mark.parametrize("kind", ["spread", "ties", "huge", "few", "same"])
def test_clusters_against_brute_force(spark, kind):
    rng = random.Random(kind)
    value = {"spread": lambda: rng.gauss(0, 1), "ties": lambda: rng.choice([-1, 0, 1]) / 1024, "huge": lambda: rng.choice([1e30, -1e30, 2.0**50, 0.25, -3.5, 1e300]), "few": lambda: rng.random(), "same": lambda: 0.125}[kind]
    rows = [(k % 50, [value() for _ in range(4)]) for k in range(3 if kind == "few" else 200)]
    rows += [(None, None), (7, [1.0]), (8, [1.0, None, 1.0, 1.0]), (9, [float("nan")] * 4), (10, [float("inf"), 0.0, 0.0, 0.0]), (None, [value() for _ in range(4)]), rows[0]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "slice": F.lit("x"), "id": F.lit("x")})
    got = clustering.cluster(table, dimension=4, k=5, rounds=4, size=16).collect()
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=str) == brute_clusters(rows, 5, 4)


def test_clusters_of_no_vectors(spark):
    assert clustering.cluster(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).collect() == []


def test_nothing_is_left_of_the_rounds(spark):
    before = {t.name for t in spark.catalog.listTables()}
    clustering.op13_centroid_clustering(spark, DATA)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_search_skips_and_agrees(monkeypatch):
    """Bounds carried over many moves give the same nearest centroids as comparing all, with far fewer distances."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 40, (400, 16)) for c in rng.normal(0, 300, (12, 16))]).astype(np.int64)
    values, seen, bounds = x[rng.choice(len(x), 24, replace=False)].copy(), [], None
    exact = clustering.squared
    monkeypatch.setattr(clustering, "squared", lambda a, b: (seen.append(a.size // 16), exact(a, b))[1])
    moved, computed = np.zeros(24), []
    for _ in range(12):
        seen.clear()
        centres = clustering.Centres(values, moved)
        seen.clear()
        bounds = clustering.search(x, centres, bounds)
        computed.append(sum(seen))
        every = np.array([exact(x, c) for c in values])
        assert (bounds[0] == every.argmin(axis=0)).all()
        assert (bounds[2] ** 2 >= every.min(axis=0)).all() and (np.maximum(bounds[3], 0) ** 2 <= np.sort(every, axis=0)[1]).all()
        total, members = clustering.sums(x, bounds[0], 24)
        new = np.where(members[:, None] > 0, total // np.maximum(members, 1)[:, None], values)
        moved, values = clustering.roots(exact(new, values)) * (1 + clustering.SLOP), new
    assert computed[0] < 24 * len(x) and computed[-1] < 2 * len(x)
