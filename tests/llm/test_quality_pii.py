"""Quality trees and personal data against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.llm import pii, quality

TEXTS = [None, "", "a b c a b c", "one two three " * 30, "line x\nline x\n\n \nline x", "w " * 60, "#tag $5 <b>|</b>\x0b\x1cé z", "a b c d a b c a b c", "word " * 30_000]


def plain_base(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {k for i, w in enumerate(windows) if counts[w] >= 2 for k in (i, i + 1, i + 2)}
    lines = (text or "").split("\n")
    dup = sum(bool(re.search("[^\x20\x09-\x0d]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_stats():
    for text in TEXTS:
        assert quality.base_stats(text)[:5] == plain_base(text)


def walk(forest, x):
    out = forest.bias
    for at in forest.roots:
        while forest.feature[at] >= 0:
            at = forest.left[at] if x[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        out += forest.value[at]
    return out


def test_trees_fit_are_flat_and_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    p = (x[:, 0] < 0.5) * 0.8 + 0.15 * np.sin(9 * x[:, 1]) + 0.1
    y = (rng.random(3000) < p).astype(float)
    forest = quality.fit(x, y, np.array([-1, 0, -1]))
    fresh = rng.random((200, 3))
    assert np.allclose(forest.raw(fresh), [walk(forest, r) for r in fresh])
    assert ((forest.raw(x) > 0) == y).mean() > 0.8
    for j in (0, 2):
        line = np.repeat(fresh[:50], 40, 0)
        line[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (np.diff(forest.raw(line).reshape(50, 40), axis=1) <= 1e-9).all()


def test_assess(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 9)) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(w + "###" for w in t.split()) for t in good]
    texts = TEXTS + good + bad
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, quality string, score double")
    n = len(TEXTS)
    labels = spark.createDataFrame([(n + i, int(i < 60), 0) for i in range(0, 120, 2)] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.assess(docs, labels).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], plain_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert all(got[n + i].kept == (i < 60) for i in range(120) if not got[n + i].base_failed)
    assert quality.assess(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    assert quality.assess(docs.limit(0), labels).count() == 0
    assert quality.assess(docs.union(docs), labels).count() == 2 * len(texts)
    again = docs.withColumn("text", F.lit("another text"))
    assert quality.train(docs.union(again), labels).roots.tolist() == quality.train(again.union(docs), labels).roots.tolist()


def test_length_has_no_ceiling():
    short, long = ("ab cd " * 600, "ab cd " * 6000)
    assert [quality.features(t, quality.base_stats(t))[0] for t in (short, long)] == [1200.0, 12_000.0]


def test_held_out_documents(spark):
    """Trained on one half of the labelled documents, it tells good from bad on the other."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    out = quality.assess(docs, half).join(labels.where("doc_id % 2 = 1 and quality is not null"), "doc_id").where("not base_failed").collect()
    right = sum(r.kept == bool(r.quality) for r in out)
    assert len(out) > 100 and right >= 0.97 * len(out), (right, len(out))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in pii.CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1]))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


PII = [None, "", "mail a@b@c.d and x.y-z@w.co.uk, a@b", "1.2.3.4.5.6.7.8 999.1.1.1 007.1.1.1 12.34.56.78", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "+1 (202) 555-0143 + 44 +12", "é😀 q@w.e " * 3, "word " * 30_000 + "a@b.c", "@@@", "a@b.c", "a@b.c"]


def test_base_spans_of_personal_data():
    for text in PII:
        assert pii.base_spans(text) == plain_spans(text), text
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choices("a1.@-+ 9", k=rng.randint(1, 40)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.1.1", "1" * 10**6, "a" * 10**6, "1." * 500_000, "a@" * 500_000, "a@" + "b" * 10**6, "+1" * 300_000, "a.b-" * 250_000 + "@c.d", "9 " * 500_000])
def test_long_runs_cost_their_length(text):
    began = time.perf_counter()
    found = pii.base_spans(text)
    assert time.perf_counter() - began < 5
    assert [k for _, k, _ in found] == ([1] if text[0] == "0" else [1] * 125_000 if text[:2] == "1." else [0] if text[:4] == "a.b-" else [])


def corpus(spark):
    rng = random.Random(6)
    fill = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    texts = [f"{fill(30)} zorblax {fill(2)} mayor@town.org {fill(2)} common quux {fill(20)}" for _ in range(16)]
    texts += [f"{fill(20)} common {fill(20)}" for _ in range(80)] + [f"{fill(20)} other@mail.net quux {fill(5)}"] * 4 + PII
    return texts, spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, base string, terms int")


def plain_disclosing(texts, levels=(0.5, 0.8), q=0.1):
    """Terms told of at each level, by the docstring's rule pair by pair."""
    n, least = len(texts), math.ceil(math.log(q) / math.log(levels[0]))
    n_t, n_c, both = Counter(), Counter(), Counter()
    for t in texts:
        t = t or ""
        spans = plain_spans(t)
        entities = {f"{k}:{t[a:b].lower()}" for a, k, b in spans}
        n_t.update({w for w in pii.WORD.findall(t.lower()) if len(w) > 2})
        n_c.update(entities)
        terms = {m[0].lower() for m in pii.WORD.finditer(t) if len(m[0]) > 2 and not any(a < m.end() and m.start() < b for a, _, b in spans)}
        both.update((c, w) for c in entities for w in terms)
    family = {x: k for x, k in both.items() if n_c[x[0]] >= least and n_c[x[0]] < n and least <= n_t[x[1]] <= n_c[x[0]] / levels[0]}
    out = []
    for level in levels:

        def chance(k, m, level=level):
            s = k / m
            return 1.0 if s <= level else math.exp(-m * (s * math.log(s / level) + ((1 - s) * math.log((1 - s) / (1 - level)) if s < 1 else 0)))

        p = {x: 10 ** (math.ceil(100 * math.log10(chance(k, n_t[x[1]])) - 1e-9) / 100) for x, k in family.items()}
        limit = max([v for v in p.values() if v * len(p) <= q * sum(u <= v for u in p.values())], default=-1)
        out.append({w for (c, w), v in p.items() if v <= limit and n * both[c, w] >= 2 * n_t[w] * n_c[c]})
    return out[0], out[0] & out[1]


def test_disclosing_terms(spark):
    texts, df = corpus(spark)
    want, removed = plain_disclosing(texts)
    found = pii.find(df)
    got = pii.disclosing(found, df).collect()
    assert {r.term for r in got} == want and "zorblax" in want and "common" not in want and {r.term for r in got if r.removed} == removed
    out = {r.doc_id: r for r in pii.spans(df).collect()}
    for i, t in enumerate(texts):
        assert [(x.start, x.ord, x.end) for x in out[i].base] == plain_spans(t)
        assert {t[x.start : x.end] for x in out[i].terms} == {w for w in pii.WORD.findall(t or "") if w in want}
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("zorblax" not in clean[i] and "[EMAIL]" in clean[i] and "common" in clean[i] for i in range(16))
    assert all(clean[i] == texts[i] for i in range(16, 96)) and pii.sanitise(df).columns == df.columns
    assert pii.spans(df.limit(0)).count() == 0


def terms_of(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: [texts[r.doc_id][x.start : x.end] for x in r.terms] for r in pii.spans(df, **kw).where(F.size("terms") > 0).collect()}


def test_a_larger_corpus_changes_no_verdict(spark):
    """Beside documents of other words, and beside some with entities of their own and words seen once."""
    texts, _ = corpus(spark)
    alone = terms_of(spark, texts)
    assert alone and terms_of(spark, texts + ["other words entirely"] * 3000) == alone
    once = [f"hapax{i} unheard{i} a{i}@b{i}.org" for i in range(1500)]
    assert terms_of(spark, texts + once) == alone


def test_single_sightings_stay(spark):
    texts = [f"unique{i} solo{i} p{i}@q{i}.net filler words" for i in range(400)] + ["filler words"] * 800 + ["twice told bob@pair.org"] * 2 + ["thrice seen eve@trio.org"] * 3
    assert terms_of(spark, texts) == {}


def test_copies_and_mixed_sightings(spark):
    """Copies count as documents, and an entity in a third of all doesn't make every word tell of it."""
    texts = ["vermilion paid eve@many.org"] * 40 + [f"vermilion {w} eve@many.org" for w in ("sent", "took", "held")] + ["call paid sent took held"] * 60
    assert terms_of(spark, texts) == {i: ["vermilion"] for i in range(43)}
    assert terms_of(spark, texts, most=1) == terms_of(spark, texts)


def test_sieves_in_deals(spark):
    texts = [f"aleph beth gimel daleth zayin word{i} eve@many.org" for i in range(30)] + ["aleph x beth"] + ["nothing here"] * 60
    found = terms_of(spark, texts)
    assert found[30] == ["aleph", "beth"] and len(found) == 31 and terms_of(spark, texts, most=2) == found


def test_terms_far_from_a_mention_and_without_one(spark):
    """A term holds over whole texts: far from the mention, a second time, and where no entity is written out."""
    far = "plain filler " * 60
    texts = [f"Zorblax {far} anna@town.org {far} zorblax 4711"] * 30 + [f"{far} ask zorblax, or anna"] + ["plain filler ask"] * 100 + [None, ""]
    assert terms_of(spark, texts) == {**{i: ["Zorblax", "zorblax", "4711"] for i in range(30)}, 30: ["zorblax"]}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("orblax" not in (t or "") for t in clean.values()) and "[EMAIL]" in clean[0] and "anna" in clean[30]
    assert all(clean[i] == texts[i] for i in range(31, len(texts)))


def test_places_of_words():
    text = "abc abcabc_abc éabc abc, a@abc.de ABC abc.abc 1abc abc"
    spans = plain_spans(text)
    want = [m.span() for m in re.finditer(r"\w+", text) if m[0] in ("abc", "ABC") and not any(a < m.end() and m.start() < b for a, _, b in spans)]
    few = {"abc", "ABC"}
    assert len(want) == 6 and sorted(pii.places(text, few, spans)) == want == pii.places(text, few | {f"x{i}" for i in range(20)}, spans)


def test_sieve_passes_every_term(spark):
    terms = [f"é{i}" for i in range(3000)]
    table = pii.sieve(spark.createDataFrame([(t,) for t in terms], "term string"))
    assert all(pii.passes(table, t) for t in terms)
    assert sum(pii.passes(table, f"x{i}") for i in range(3000)) < 60
    assert not pii.passes(pii.sieve(spark.createDataFrame([], "term string")), "x")


def test_query_digest(spark, tmp_path):
    texts, df = corpus(spark)
    df.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op4_pii(spark, str(tmp_path)).collect():
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.spans == said if not r.n_term else said != r.spans
