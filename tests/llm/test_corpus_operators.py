"""Operators on whole corpora against brute force."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import canonical
from trialspark.llm import blocks, hashing, neighbours, ngram_join, packing, passages, quality, secret_scan, shared
from trialspark.llm.queries import ORACLE_SQL, QUERIES
from trialspark.llm.shared import connected_components, scratch


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text, size):
    w = words_of(text)
    if len(w) >= size:
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    return {tuple(w)} if w else set()


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def linked(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    pairs = {(a, b) for ids in at.values() for a in ids for b in ids if a < b}
    edges = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = components(sets, edges)
    return {i: (len(sets[i]), found[i]) for i in sets}


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_hashing_equals_words(spark, sf_dir):
    texts = [r["text"] for r in documents(spark, sf_dir).limit(60).collect()] + ["", " \n", "A b\tC", "é É", "x" * 3_000_000 + " y"]
    for size in (1, 4):
        flat, off = hashing.shingle_sets([t.encode() for t in texts], size)
        seen = {}
        for k, t in enumerate(texts):
            want = shingles(t, size)
            got = flat[off[k] : off[k + 1]]
            assert len(got) == len(want) and (np.diff(got.astype(np.float64)) >= 0).all()
            if want in seen.values():
                assert any((flat[off[j] : off[j + 1]] == got).all() for j, s in seen.items() if s == want)
            seen[k] = want
    a, _ = hashing.shingle_sets([b"one two three four"], 4)
    b, _ = hashing.shingle_sets([b"ONE  two\nthree\tfour"], 4)
    c, _ = hashing.shingle_sets([b"one two four three"], 4)
    assert a == b and a != c


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got}
    assert set(want) - set(got) <= {5}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_small_graphs_take_no_rounds(spark, monkeypatch):
    path = [(k, k + 1) for k in range(500)]
    edges = spark.createDataFrame([path[k * 193 % 500] for k in range(500)], "a bigint, b bigint").repartition(8)
    written = []
    monkeypatch.setattr(shared, "materialise", lambda df, tag, f=shared.materialise: written.append(tag) or f(df, tag))
    assert {tuple(r) for r in connected_components(edges).collect()} == {(k, 0) for k in range(501)}
    assert len(written) == 2
    monkeypatch.setattr(shared, "_WHOLE", 0)  # a larger graph goes through the rounds
    assert {tuple(r) for r in connected_components(edges).collect()} == {(k, 0) for k in range(501)}
    assert len(written) > 4


def test_leaves_of_larger_graphs_take_no_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.permutation(400)  # a long path of centres, two of which share a leaf
    edges = [(400 + k, int(centre[k % 400])) for k in range(3000)] + [(400 + k, int(centre[k + 1])) for k in range(399)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(8)
    written = []
    monkeypatch.setattr(shared, "materialise", lambda df, tag, f=shared.materialise: written.append(tag) or f(df, tag))
    monkeypatch.setattr(shared, "_WHOLE", 1000)
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == components({x for e in edges for x in e}, edges)
    assert len(written) == 5  # contracted, neighbours, without leaves, to the end, with the leaves


def test_components_of_larger_graphs_with_long_paths(spark, monkeypatch):
    monkeypatch.setattr(shared, "_WHOLE", 0)
    rng = np.random.default_rng(6)
    names = rng.permutation(700)
    edges = [(int(names[k]), int(names[k + 1])) for k in range(300)] + [(k, k + 3) for k in range(1000, 1200)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2300, (140, 2)) if a != b]
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(8)).collect()
    want = components({x for e in edges for x in e}, edges)
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want


def test_ngram_join_against_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir).where("doc_id < 200")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for size, percent in ((4, 85), (5, 80), (1, 50)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(docs, size, percent).collect()}
        assert got == linked(rows, size, percent)


def test_ngram_join_edge_cases(spark):
    text = " ".join(f"w{k}" for k in range(60))
    near = text.replace("w59", "zz")
    rows = [(9, text, 1), (3, text.upper(), 1), (4, near, 1), (5, None, 1), (6, "", 1), (7, "one two", 1), (8, "One\ntwo", 1), (None, text, 1), (12, "other words here now", 1), (12, "one two", 1), (20, "solo words only for me", 1), (20, "solo words only for me", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint")
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(df).collect())
    assert got == sorted([(9, 57, 3), (3, 57, 3), (4, 57, 3), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7), (-1, 57, None), (12, 1, 7), (12, 1, 7), (20, 2, 20), (20, 2, 20)], key=str) or got == sorted(
        [(9, 57, 3), (3, 57, 3), (4, 57, 3), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7), (-1, 57, None), (12, 1, 7), (12, 1, 7), (20, 2, 20), (20, 2, 20)], key=lambda r: r[:2]
    )
    assert ngram_join.similarity_components(df.limit(0)).count() == 0


def test_large_clusters_are_compared_whole(spark, monkeypatch):
    """Many near copies, few of which link directly, in cells far smaller than the cluster."""
    monkeypatch.setattr(blocks, "CELL", 8)
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.choice(80, 2 + i % 4, replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(df, 2, 85).collect()}
    assert got == linked(rows, 2, 85)


def test_small_clusters_and_random_cells_go_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CELL", 8)
    passes = []
    monkeypatch.setattr(blocks, "link_cells", lambda *a, f=blocks.link_cells: passes.append(1) or f(*a))
    items = np.arange(40, dtype="<u8").tobytes()
    rows = [(0, k, items) for k in range(30)] + [(1, 100, items), (1, 101, items)]
    links = blocks.link_clusters(spark.createDataFrame(rows, "cluster bigint, uid bigint, items binary"), 85)
    assert {tuple(r) for r in connected_components(links).collect()} == {(k, 0) for k in range(30)} | {(100, 100), (101, 100)}
    assert len(passes) == 2


def test_links_of_small_clusters_stay_out_of_the_search_within_large_ones(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CELL", 8)
    searched = []
    monkeypatch.setattr(blocks, "connected_components", lambda e, f=blocks.connected_components: searched.append({r["a"] for r in e.collect()}) or f(e))
    items = np.arange(40, dtype="<u8").tobytes()
    rows = [(0, k, items) for k in range(30)] + [(c, 100 * c + k, items) for c in range(1, 9) for k in range(4)] + [(9, 5, items), (9, 901, items)]
    links = blocks.link_clusters(spark.createDataFrame(rows, "cluster bigint, uid bigint, items binary"), 85)
    want = {(k, 0) for k in range(30)} | {(100 * c + k, 100 * c) for c in range(1, 9) for k in range(4)} | {(901, 0)}
    assert {tuple(r) for r in connected_components(links).collect()} == want
    assert len(searched) == 1 and searched[0] <= set(range(30))


def test_overlaps_by_fragment(monkeypatch):
    monkeypatch.setattr(blocks, "FRAGMENT", 3)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 25))).astype(np.uint64) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = blocks.overlaps(sets)
    assert [[int(v) for v in r] for r in got - np.diag(np.diag(got))] == [[0 if i == j else v for j, v in enumerate(r)] for i, r in enumerate(want)]
    assert blocks.overlaps(sets[:4], sets).astype(int).tolist() == want[:4]


def filler(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))


def test_shared_passages_are_found(spark):
    rng = np.random.default_rng(1)
    rows, copies = [], []
    for k in range(12):
        passage = filler(rng, 50)
        for j in range(2 + k % 3):
            copies.append((len(rows), k))
            rows.append((len(rows), f"{filler(rng, 5 + 17 * j)} {passage} {filler(rng, 40)}"))
    clean = len(rows)
    rows += [(clean + k, filler(rng, 120)) for k in range(20)]
    rows += [(900, None), (901, ""), (902, "short text"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("content", F.lit("clash"))
    out = passages.passages(df).collect()
    first = {}
    for d, k in copies:
        first.setdefault(k, d)
    assert {(r["doc_id"], r["kept_in"]) for r in out} == {(d, first[k]) for d, k in copies if first[k] != d}
    for r in out:
        cut = dict(rows)[r["doc_id"]].encode()[r["start"] : r["stop"]].decode()
        assert " ".join(cut.split()[3:-3]) in dict(rows)[r["kept_in"]]  # a similar paragraph may reach a word or two beyond
    left = {r["doc_id"]: r["text"] for r in passages.remove_repeats(df).collect()}
    assert len(left) == len(rows) and left[0] == rows[0][1] and left[clean] == rows[clean][1]
    assert passages.passages(df.limit(0)).count() == 0


def test_near_paragraphs_are_linked(spark):
    rng = np.random.default_rng(3)
    text = filler(rng, 25)
    w = text.split()
    near = " ".join([*w[:-1], "changed"])  # 20 of 22 shingles: similar
    far = " ".join([*w[:12], "changed", *w[13:]])  # 16 of 26: not
    df = spark.createDataFrame([(1, text), (2, near), (3, far), (4, text.upper())], "doc_id bigint, text string")
    assert {(r["doc_id"], r["kept_in"]) for r in passages.passages(df).collect()} == {(2, 1), (4, 1)}


def test_exact_repeats_are_covered_whole(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for k in range(60):
        passage = filler(rng, (51, 60, 75, 100, 200)[k % 5])
        ends = [[f"{side}{k}_{copy}" for side in "ab"] for copy in (0, 1)]  # words beside the passage differ
        for copy, (a, b) in enumerate(ends):
            head = f"{filler(rng, k % 40)} {a} " if k % 3 else ""
            tail = f" {b} {filler(rng, k % 30)}" if k % 4 else ""
            if copy:
                start = len(head.encode())
                want[1000 + k] = (start, start + len(passage.encode()), k)
            rows.append((1000 * copy + k, head + passage + tail))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = passages.passages(df).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(want)  # one row for each
    for r in out:
        start, stop, kept_in = want[r["doc_id"]]
        raw = dict(rows)[r["doc_id"]].encode()
        assert r["kept_in"] == kept_in and r["start"] <= start and r["stop"] >= stop
        beyond = raw[r["start"] : start].split(), raw[stop : r["stop"]].split()
        assert max(map(len, beyond)) <= 2  # a similar paragraph may reach a word or two beyond
    exact = sum((r["start"], r["stop"], r["kept_in"]) == want[r["doc_id"]] for r in out)
    assert exact >= 0.9 * len(out)


def test_passages_repeated_in_one_document_stay(spark):
    text = filler(np.random.default_rng(5), 60)
    df = spark.createDataFrame([(1, f"{text} {text}")], "doc_id bigint, text string")
    assert passages.passages(df).count() == 0


def test_repeats_of_one_id_are_cut_in_their_own_text(spark):
    rng = np.random.default_rng(7)
    passage, other = filler(rng, 80), filler(rng, 200)
    df = spark.createDataFrame([(1, passage), (2, f"{filler(rng, 9)} {passage} end"), (2, other), (2, other)], "doc_id bigint, text string").withColumn("_cuts", F.lit(1)).withColumn("print", F.lit("x"))
    left = passages.remove_repeats(df)
    assert left.columns == df.columns
    texts = sorted((r["doc_id"], r["text"]) for r in left.collect())
    assert texts.count((2, other)) == 2 and (1, passage) in texts
    assert max(len(t) for d, t in texts if t != other and d == 2) < 120


def test_passage_query_against_brute_force(spark, sf_dir):
    """Every word of a 50-word run that an earlier document has is covered; what is covered is in the kept document for the most part."""
    docs = {r["doc_id"]: r["text"] or "" for r in documents(spark, sf_dir).collect()}
    spans, kept = defaultdict(list), defaultdict(set)
    for r in QUERIES["op7_substring_dedup"](spark, sf_dir).collect():
        spans[r["doc_id"]].append((r["start"], r["stop"]))
        kept[r["doc_id"]].add(r["kept_in"])
        part = shingles(docs[r["doc_id"]].encode()[r["start"] : r["stop"]].decode(), 5)
        # a merged passage may come from several documents; its own kept ones are the smallest of theirs
        assert len(part & set().union(*(shingles(docs[d], 5) for d in docs if d < r["doc_id"]))) >= 0.6 * len(part)
    places = {d: [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())] for d, t in docs.items()}
    first = {}
    for d in sorted(docs):
        w = words_of(docs[d])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), d)
    missed = total = 0
    for d in sorted(docs):
        w = words_of(docs[d])
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < d:
                a, b = places[d][k][0], places[d][k + 49][1]
                total += 1
                missed += not any(s <= a and b <= e for s, e in spans[d])
    assert total and missed == 0
    assert set(spans) and all(min(k) < d for d, k in kept.items())


RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
]


def spans_of(text):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, fine) in enumerate(RULES) for m in re.finditer(p, text or "", re.ASCII) if fine(m)]
    return ",".join(s for _, _, s in sorted(found))


SECRETS = [
    None, "", "nothing", "Password: hunter22 and token=abc", "é𝒳 secret='x12345' é api_key = \"k_9.9=\"", "secret=token: abcdef", "AKIA" + "A1" * 8 + " AKIASHORT", "0123456789abcdef01234567",
    "token: 0123456789abcdef0123456789abcdef" * 3, "a" * 23 + " " + "b" * 30, "passwd=  'AKIA" + "Z" * 30 + "'", "tOkEn:=abcdefg\n\n" * 500,
]


def test_secret_scan_against_regular_expressions(spark):
    df = spark.createDataFrame(list(enumerate(SECRETS)) + [(None, SECRETS[3]), (3, SECRETS[3])], "path bigint, content string").withColumn("blob", F.lit("clash"))
    paths, findings = secret_scan.scan(df, scratch(spark, "ledger"))
    got = sorted((-1 if r["path"] is None else r["path"], r["spans"], r["n_assign"] + r["n_access"] + r["n_hex"]) for r in secret_scan.report(paths, findings).collect())
    want = [(i, spans_of(t)) for i, t in enumerate(SECRETS)] + [(-1, spans_of(SECRETS[3])), (3, spans_of(SECRETS[3]))]
    assert got == sorted((i, s, len(s.split(",")) if s else 0) for i, s in want)


def test_ledger_scans_only_what_is_new(spark):
    ledger = scratch(spark, "ledger")
    make = lambda rows: spark.createDataFrame(rows, "path bigint, content string")
    secret_scan.scan(make([(1, SECRETS[3]), (2, "nothing")]), ledger)
    n = spark.read.parquet(f"{ledger}/scanned").count()
    assert n == 2 * len(secret_scan.RULES)
    paths, findings = secret_scan.scan(make([(1, SECRETS[3]), (7, SECRETS[3]), (8, SECRETS[7])]), ledger)
    scanned = spark.read.parquet(f"{ledger}/scanned")
    assert scanned.count() == n + len(secret_scan.RULES) == scanned.distinct().count()
    assert {r["path"]: r["spans"] for r in secret_scan.report(paths, findings).collect()} == {1: spans_of(SECRETS[3]), 7: spans_of(SECRETS[3]), 8: spans_of(SECRETS[7])}
    newer = (*secret_scan.RULES[:2], secret_scan.Rule("hex", 2, "[0-9a-f]{30,}", 0, 30))
    paths, findings = secret_scan.scan(make([(8, SECRETS[7]), (9, "b" * 30)]), ledger, newer)
    assert {r["path"]: r["n_hex"] for r in secret_scan.report(paths, findings, newer).collect()} == {8: 0, 9: 1}
    assert spark.read.parquet(f"{ledger}/scanned").where("rule = 'hex@2'").count() == 2
    paths, findings = secret_scan.scan(make([]), scratch(spark, "ledger"))
    assert secret_scan.report(paths, findings).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id bigint, text string")
    for r in secret_scan.redact(df, scratch(spark, "ledger")).collect():
        text, out, at = SECRETS[r["doc_id"]], "", 0
        for a, b in sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in filter(None, spans_of(text).split(","))):
            if a >= at:
                out += text[at:a] + secret_scan.PLACEHOLDER
            at = max(at, b)
        assert r["text"] == (None if text is None else out + text[at:])


def test_redaction_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "secret=abcdef", 5, "x")], "doc_id bigint, text string, _blob int, _Spans string")
    assert [tuple(r) for r in secret_scan.redact(df, scratch(spark, "ledger")).collect()] == [(1, secret_scan.PLACEHOLDER, 5, "x")]


def test_later_rules_scan_for_themselves_only(spark, sf_dir):
    ledger = scratch(spark, "ledger")
    texts = ["ghp_" + "a1B2" * 9, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKKF", "-----BEGIN RSA PRIVATE KEY-----", "password: hunter22"]
    df = spark.createDataFrame(list(enumerate(texts)), "path bigint, content string")
    secret_scan.scan(df, ledger)
    paths, findings = secret_scan.scan(df, ledger, secret_scan.RULES + secret_scan.MORE_RULES)
    scanned = spark.read.parquet(f"{ledger}/scanned")
    assert scanned.count() == scanned.distinct().count() == 6 * len(texts)
    got = {r["path"]: (r["base_spans"], r["spans"]) for r in secret_scan.report(paths, findings, more=secret_scan.MORE_RULES).collect()}
    assert got == {0: ("", f"forge:0:{len(texts[0])}"), 1: ("", f"jwt:0:{len(texts[1])}"), 2: ("", f"pem:0:{len(texts[2])}"), 3: ("assign:0:18", "assign:0:18")}


def test_secret_query_uses_no_python(spark, sf_dir):
    plan = QUERIES["op9_secret_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(name, spark, sf_dir, duck):
    assert canonical(QUERIES[name](spark, sf_dir).toPandas()) == canonical(duck.execute(ORACLE_SQL[name]).df())


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op4_quality"](spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.97
    assert out.where("score is null or score < 0 or score > 1").count() == 0
    assert out.count() == documents(spark, sf).count()


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "words in a text"), (3, "words in a text"), (None, "x")], "doc_id bigint, text string").withColumn("items", F.lit(1))
    none = quality.fit(docs, spark.createDataFrame([], "doc_id bigint, label int"))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    one = quality.fit(docs, spark.createDataFrame([(3, 1), (99, 0), (None, 0), (2, None)], "doc_id bigint, label int"))
    assert {r["score"] for r in quality.score(docs, one).collect()} == {1.0}
    both = quality.fit(docs, spark.createDataFrame([(3, 1), (2, 0)], "doc_id bigint, label int"))
    scores = quality.score(docs, both).collect()
    assert len(scores) == 5 and all(0 <= r["score"] <= 1 for r in scores)
    assert quality.score(docs.limit(0), both).count() == 0


def slow_quality(model, text):
    """The score of one text, word by word."""
    words, shapes, _, rates = quality.analyse([text.encode()])
    pooled = np.zeros(2 * quality.DIMENSIONS)
    for side, items in enumerate((words.tolist(), shapes.tolist())):
        for i in items:
            for j in range(quality.DIMENSIONS):
                pooled[side * quality.DIMENSIONS + j] += model.vectors[i][j] / len(items)
    x = [*pooled, *rates[0]]
    net = model.network
    z = [max(-8.0, min(8.0, (v - c) / s)) for v, c, s in zip(x, net.centre, net.scale, strict=True)]
    w1, b1, w2, b2 = net.parts
    hidden = [np.tanh(sum(z[i] * w1[i, h] for i in range(len(z))) + b1[h]) for h in range(len(b1))]
    logit = sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0]
    return 1 / (1 + np.exp(-logit / net.temperature))


def slow_contexts(text, index):
    """Sums of the index vectors of the items within two words."""
    words, shapes, _, _ = quality.analyse([text.encode()])
    out = defaultdict(lambda: np.zeros(quality.DIMENSIONS, dtype=np.int64))
    for k in range(len(words)):
        for j in range(max(0, k - 2), min(len(words), k + 3)):
            if j != k:
                for item in (words[k], shapes[k]):
                    out[int(item)] += index[words[j]] + index[shapes[j]]
    return out


def test_quality_against_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, quality.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    some = {r["doc_id"]: r["text"] or "" for r in docs.orderBy("doc_id").limit(40).collect()}
    got = {r["doc_id"]: r["score"] for r in QUERIES["op4_quality"](spark, sf_dir).collect()}
    for d, text in some.items():
        assert got[d] == pytest.approx(slow_quality(model, text), abs=1e-5)
    index = quality.index_vectors(quality.WORDS + quality.SHAPES)
    for text in list(some.values())[:5]:
        sums = quality.context_sums(*quality.analyse([text.encode()])[:3], index)
        want = slow_contexts(text, index)
        assert set(np.flatnonzero(sums.any(1))) == {i for i, v in want.items() if v.any()}
        assert all((sums[i] == v).all() for i, v in want.items())


def test_quality_takes_labels_that_have_documents(spark):
    docs = spark.createDataFrame([(k, ("fine words here " if k % 2 else "XX!! ") * 20) for k in range(20)], "doc_id bigint, text string")
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels, 10)).collect()}
    assert all((s > 0.5) == bool(d % 2) for d, s in scores.items())
    with pytest.raises(ValueError, match="exists"):
        quality.score(docs.withColumn("Score", F.lit(1)), quality.QualityModel(None, quality.Network(constant=0.5)))


def check_packing(items, out, capacity, per_source):
    source = {i: s for i, s, _, _ in items}
    cluster = {i: c for i, _, c, _ in items}
    total = defaultdict(int)
    bins = defaultdict(list)
    for r in out:
        total[r["doc_id"]] += r["n_tokens"]
        bins[r["bin_id"]].append(r)
    assert total == {i: max(n or 0, 0) for i, _, _, n in items}
    for rows in bins.values():
        used = sum(r["n_tokens"] for r in rows)
        assert used <= capacity and {r["bin_tokens"] for r in rows} == {used}
        ends = 0
        for r in sorted(rows, key=lambda r: (r["bin_offset"], r["n_tokens"])):
            assert r["bin_offset"] == ends
            ends += r["n_tokens"]
        names = [source[r["doc_id"]] for r in rows]
        assert all(names.count(s) <= per_source for s in names)
        same = [cluster[r["doc_id"]] for r in rows if cluster[r["doc_id"]] is not None]
        assert len(same) == len(set(same))


def test_packing_respects_all_conflicts(spark):
    rng = np.random.default_rng(6)
    items = [(i, "hot" if i % 3 == 0 else f"s{i % 5}", int(rng.integers(0, 60)) if i % 2 else None, int(rng.integers(0, 130))) for i in range(700)]
    items += [(700, None, None, None), (701, None, None, 100), (702, "hot", 1, 517), (703, "hot", 1, -5)]
    df = spark.createDataFrame(items, "doc_id bigint, source string, cluster bigint, n_tokens bigint").withColumn("bin_id", F.lit("clash"))
    check_packing(items, packing.pack(df, 100, 2).collect(), 100, 2)
    assert packing.pack(df.limit(0)).count() == 0


def test_equal_rows_are_dealt_to_all_shards(spark):
    df = spark.range(8000, numPartitions=4).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).alias("cluster"), F.lit(1).alias("n_tokens"))
    out = packing.pack(df, 100, 2)
    assert out.count() == out.select("bin_id").distinct().count() == 8000  # copies share no bin
    assert out.select(F.shiftright("bin_id", 32)).distinct().count() == 8


def test_packing_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(8)
    items = sorted(((int(rng.integers(1, 60)), int(rng.integers(0, 4)), int(rng.integers(0, 30))) for _ in range(300)), reverse=True)
    free, sources, clusters, want = [], [], [], []
    for n, s, c in items:
        fits = [(free[b], b) for b in range(len(free)) if free[b] >= n and sources[b].count(s) < 2 and (c not in clusters[b])]
        b = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(100), sources.append([]), clusters.append(set())
        want.append((b, 100 - free[b]))
        free[b] -= n
        sources[b].append(s)
        clusters[b].add(c)
    assert packing.pack_items(items, 100, 2) == want


def test_packing_query_keeps_every_document(spark, sf_dir):
    out = QUERIES["op8_best_fit_packing"](spark, sf_dir)
    assert out.select("doc_id").distinct().count() == documents(spark, sf_dir).count()
    assert out.groupBy("bin_id").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > packing.CAPACITY).count() == 0


def nearest(vectors, q, k):
    ids = np.array(sorted(i for i in vectors if i != q))
    d = np.array([np.sqrt(((vectors[i] - vectors[q]) ** 2).sum()) for i in ids])
    order = np.lexsort((ids, d))[:k]
    return list(zip(ids[order].tolist(), d[order].tolist(), strict=True))


def test_neighbours_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows}
    out = defaultdict(list)
    for r in QUERIES["op10_nearest_neighbours"](spark, sf_dir).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(out) == {i for i in vectors if i % 100 == 0}
    hits = 0
    for q, found in out.items():
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(s == pytest.approx(np.sqrt(((vectors[i] - vectors[q]) ** 2).sum()), rel=1e-12) for _, i, s in found)
        hits += len({i for i, _ in nearest(vectors, q, 10)} & {i for _, i, _ in found})
    assert hits >= 0.9 * 10 * len(out)


def test_recall_on_a_larger_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows}
    found = {(r["query_id"], r["vec_id"]) for r in QUERIES["op10_nearest_neighbours"](spark, sf).collect()}
    queries = [i for i in vectors if i % 100 == 0]
    want = {(q, i) for q in queries for i, _ in nearest(vectors, q, 10)}
    assert len(found & want) >= 0.9 * len(want)


def test_recall_with_small_cells_and_a_third_of_copies(spark, monkeypatch):
    """Cells far smaller than the table, so that descent and walks decide; copies are ranked by id."""
    monkeypatch.setattr(neighbours, "START_CELL", 100)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 24))
    x = centres[rng.integers(0, 20, 3000)] + 0.7 * rng.normal(size=(3000, 24))
    x[rng.permutation(3000)[:1000]] = x[0]
    vectors = dict(enumerate(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id bigint, embedding array<double>")
    v = neighbours.usable(df)
    out = neighbours.nearest(v, v.where("id % 20 = 0").select(F.col("id").alias("query_id")), 10).collect()
    found = {(r["query_id"], r["vec_id"]) for r in out}
    queries = [i for i in vectors if i % 20 == 0]
    want = {(q, i) for q in queries for i, _ in nearest(vectors, q, 10)}
    assert len(out) == len(found) == len(want) and len(found & want) >= 0.9 * len(want)
    copies = [q for q in queries if (x[q] == x[0]).all()]
    assert len(copies) > 20
    for q in copies:
        assert {i for a, i in found if a == q} == {i for a, i in want if a == q}


def test_vectors_of_many_lengths(spark):
    rows = [(i, [float(i % 7 + 1)] * (1 + i % 90)) for i in range(900)]
    v = neighbours.usable(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    out = neighbours.nearest(v, v.where("id % 100 = 0").select(F.col("id").alias("query_id")), 20).collect()
    for q in range(0, 900, 100):
        same = {i for i, x in rows if len(x) == len(rows[q][1]) and i != q}
        assert {r["vec_id"] for r in out if r["query_id"] == q} == same


def test_neighbour_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (2, [1.0, 1.0]), (100, [1.0, 0.5]), (200, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("vec", F.lit("clash"))
    v = neighbours.usable(df)
    assert sorted(r["id"] for r in v.collect()) == [0, 1, 2, 8, 9, 100]
    out = neighbours.nearest(v, v.where("id % 100 = 0").select(F.col("id").alias("query_id")), 3).collect()
    assert {q: [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100)} == {0: [1, 8, 100], 100: [0, 1, 2]}
    none = neighbours.usable(df.limit(0))
    assert neighbours.nearest(none, none.select(F.col("id").alias("query_id")), 3).count() == 0
