"""Divergence audit and fill-in-middle on odd rows, against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import database, difference
from viaduct.llm import divergence, fim
from viaduct.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, N int, OUTPUT string"


@pytest.fixture(scope="module")
def odd(spark):
    draw = random.Random(5)
    vocabulary = ["Aa", "aa", "é", "ß", "the", "of", "x", "Zz", "日本", "co-op", "don't"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 30))), draw.choice(["en", "de", None]), draw.choice(["a", "b", "B", "é", None]), 1, "x") for i in range(200)]
    rows += [(None, None, None, None, None, None), (7, "", "fr", "z", 1, ""), (7, "", "fr", "y", 1, ""), (8, "the <P> of", "en", "a", 1, ""), (9, "<" * 50 + "S>P>M> " * 40, "en", "a", 1, "")]
    rows += [(10, "only here once", "la", "solo", 1, "")] * 4
    return spark.createDataFrame(rows, SCHEMA)


def plain_audit(rows):
    docs = [((r.lang or ""), (r.source or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))) for r in rows]
    found, n, groups = set(), defaultdict(Counter), defaultdict(set)
    held = defaultdict(Counter)
    for lang, source, words in docs:
        n[lang, source].update(words), held[lang].update(set(words)), groups[lang].add(source)
    for lang, sources in groups.items():
        kept = [t for t, d in held[lang].items() if d >= 3]
        share = lambda count: {t: 1 + 10**9 * (count[t] + 1) // (sum(count[x] for x in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        q = share(sum((n[lang, s] for s in sources), Counter()))
        p = {s: share(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources - {s}]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, 10**9), ("term", terms, 200)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    found.add((lang, s, part, item, value, rank))
    return found


def test_audit_of_odd_rows(odd):
    assert {tuple(r) for r in divergence.audit(odd).collect()} == plain_audit(odd.collect())


def test_audit_keeps_to_the_highest_terms(odd):
    got = {(r.lang, r.source, r.item): r["rank"] for r in divergence.audit(odd, most=2).where("part = 'term'").collect()}
    want = {(x[0], x[1], x[3]): x[5] for x in plain_audit(odd.collect()) if x[2] == "term" and x[5] <= 2}
    assert got == want


def test_empty_tables(spark, odd):
    assert divergence.audit(odd.limit(0)).count() == 0 and fim.fill_in_middle(odd.limit(0)).count() == 0


def test_partial_sums_and_long_texts(spark):
    text = "Aé " * 300_000 + "b" * 5_000_000
    rows = spark.createDataFrame([(text, "l", "s"), ("b a a", "l", "s")], "text string, lang string, source string")
    want = Counter({("aé"): 300_000, "b" * 5_000_000: 1, "b": 1, "a": 2})
    for held in (0, 10**6):
        got = divergence.count_terms(rows, held).groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()
        assert {r.term: r.n for r in got} == want and all(r.docs == 1 for r in got)


def test_beyond_the_bound_of_broadcasts(spark):
    from viaduct.operators.tables import join_small

    left, right = spark.range(500).selectExpr("id % 7 AS k", "id AS v"), spark.range(5).selectExpr("id AS k", "id * 2 AS w")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, join_small(left, right, ["k"], most=1).collect())) == want
    assert sorted(map(tuple, join_small(left, right, ["k"]).collect())) == want


def test_a_state_hangs_on_two_bytes():
    following, _ = fim.automaton()
    settled = following[following[:, :, None], np.arange(256)]
    assert (settled == settled[0]).all()


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 20])
def test_scan_counts_units_and_sentinels(block):
    draw = random.Random(block)
    for _ in range(60):
        text = "".join(draw.choice(["a", "P", "S", "M", "<", ">", "é", "日", "😀", " ", "\n", "\0"]) for _ in range(draw.randint(0, 60)))
        data = text.encode()
        begun = fim.scan(data, block)
        units = [m.start() for m in re.finditer("(?s)[A-Za-z]+|[^A-Za-z]", text)]
        assert fim.count(begun, 0, len(data), fim.UNIT, block) == len(units)
        assert fim.count(begun, 0, len(data), fim.CHARACTER, block) == len(text)
        assert fim.count(begun, 0, len(data), fim.SENTINEL, block) == len(re.findall("<[PSM]>", text))
        assert [fim.locate(begun, 0, len(data), k, block) for k in range(len(units) + 1)] == [len(text[:x].encode()) for x in [*units, len(text)]]


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall("(?s)[A-Za-z]+|[^A-Za-z]", text)
    said = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(said[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fim_of_odd_rows(odd):
    done = fim.restore(fim.fill_in_middle(odd, most_bytes=500)).collect()
    assert set(done[0].asDict()) == {"doc_id", "text", "lang", "source", "n", "form", "prefix_chars", "middle_chars", "output", "restored"}
    assert len(done) == odd.count() and {r.form for r in done} == {"plain", "psm", "spm"}
    for r in done:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text) and r.restored == (r.text or "")


def test_fim_of_a_long_text(spark):
    text = "é<ab 日" * 400_000
    (r,) = fim.restore(fim.fill_in_middle(spark.createDataFrame([(3, text)], "doc_id long, text string"))).collect()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(3, text) and r.restored == text


@pytest.mark.parametrize("name", ["op12_divergence", "op13_fim"])
def test_sql_on_odd_rows(spark, odd, tmp_path, name):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.Table.from_pandas(odd.drop("N", "OUTPUT").toPandas().astype({"doc_id": "Int64"})), tmp_path / "documents.parquet")
    assert difference(spark, database(str(tmp_path)), QUERIES[name], ORACLE_SQL[name], str(tmp_path)) is None
