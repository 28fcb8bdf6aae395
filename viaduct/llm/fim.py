"""Fill-in-middle transformation, with cuts found by a byte automaton.

The automaton reads UTF-8 bytes: its table says for each state and byte what comes next and what the
transition begins, a unit (a run of letters or any other character), a character or the end of a sentinel.
A byte leads to a state that the two bytes before and itself decide, whatever came earlier, so numpy runs the
table over all places of a block at once, and a block needs two bytes of the one before. The first pass keeps
what each transition begins, one byte a byte of text, and counts it by document; the second finds the
places of the two cuts among the transitions counted. Texts of a batch are read one after another with a byte
between them that no text holds and that sends every state back to the first.

Cuts are drawn from SHA-256 of a seed and the doc_id, so a document is treated alike wherever it stands. A
text that holds a sentinel stays plain, so the parts of any other can be told apart again.

Defined results: null and empty texts are plain and give an empty output; a null doc_id is drawn for as if
it were an empty one; rows that repeat are treated alike; long texts are scanned in blocks; an empty table
gives no rows; input columns named as results are left out, others are carried on.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from viaduct.llm.common import table

SENTINELS = (b"<P>", b"<S>", b"<M>")
PLAIN_FROM, SPM_BELOW = 90, 20  # of a hundred
UNIT, CHARACTER, SENTINEL = 1, 2, 4
GAP = 0xFF
RESULTS = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """``following`` and ``begun`` of states x bytes. States: after anything else, within letters, after ``<``,
    after ``<`` and the letter of a sentinel."""
    other, letters, opened, named = range(4)
    following, begun = np.zeros((4, 256), np.uint8), np.zeros((4, 256), np.uint8)
    names = {s[1] for s in SENTINELS}
    for state in range(4):
        for byte in range(256):
            letter = chr(byte).isalpha() and byte < 128
            if byte == GAP or 0x80 <= byte < 0xC0:  # between texts, or within a character
                to, does = other, 0
            elif letter:
                to = named if state == opened and byte in names else letters
                does = CHARACTER | (0 if state in (letters, named) else UNIT)
            else:
                to, does = opened if byte == ord("<") else other, CHARACTER | UNIT
                if state == named and byte == ord(">"):
                    does |= SENTINEL
            following[state, byte], begun[state, byte] = to, does
    return following, begun


FOLLOWING, BEGUN = (x.ravel() for x in automaton())


def scan(data: bytes, block: int = 1 << 20) -> np.ndarray:
    """What the transition at each byte begins."""
    raw = np.frombuffer(bytes([GAP, GAP]) + data, np.uint8)
    out = np.empty(len(data), np.uint8)
    for at in range(0, len(data), block):
        b = raw[at : at + block + 2]
        state = FOLLOWING[b[:-2]].astype(np.uint16)
        state = FOLLOWING[(state << 8) | b[1:-1]].astype(np.uint16)
        out[at : at + block] = BEGUN[(state << 8) | b[2:]]
    return out


def count(begun: np.ndarray, start: int, stop: int, what: int, block: int = 1 << 20) -> int:
    return sum(int(np.count_nonzero(begun[at : min(at + block, stop)] & what)) for at in range(start, stop, block))


def locate(begun: np.ndarray, start: int, stop: int, k: int, block: int = 1 << 20) -> int:
    """The place where the ``k``-th unit from ``start`` begins, ``stop`` after the last."""
    for at in range(start, stop, block):
        found = begun[at : min(at + block, stop)] & UNIT
        n = int(np.count_nonzero(found))
        if k < n:
            return at + int(np.flatnonzero(found)[k])
        k -= n
    return stop


def draws(seed: str, doc_id) -> list[int]:
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(said[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transform_texts(ids: list, texts: list[bytes], seed: str) -> list[tuple]:
    """``n, form, prefix_chars, middle_chars, output`` of each text."""
    begun = scan(bytes([GAP]).join(texts))
    out, start = [], 0
    for doc_id, text in zip(ids, texts, strict=True):
        stop = start + len(text)
        n = count(begun, start, stop, UNIT)
        h = draws(seed, doc_id)
        if not text or h[2] % 100 >= PLAIN_FROM or count(begun, start, stop, SENTINEL):
            out.append((n, "plain", None, None, text))
        else:
            first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            a, b = locate(begun, start, stop, first), locate(begun, start, stop, second)
            prefix, middle, suffix = text[: a - start], text[a - start : b - start], text[b - start :]
            sizes = count(begun, start, a, CHARACTER), count(begun, a, b, CHARACTER)
            p, s, m = SENTINELS
            if h[3] % 100 < SPM_BELOW:
                out.append((n, "spm", *sizes, b"".join((s, suffix, p, prefix, m, middle))))
            else:
                out.append((n, "psm", *sizes, b"".join((p, prefix, s, suffix, m, middle))))
        start = stop + 1
    return out


def fill_in_middle(docs: DataFrame, seed: str = "1", most_bytes: int = 1 << 23) -> DataFrame:
    """``docs`` with ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and the ``output`` text. A task works on
    about ``most_bytes`` of texts at a time, or on one longer text."""
    import pyarrow as pa

    taken = {f.name.lower() for f in RESULTS}
    carried = [c for c in docs.columns if c.lower() not in taken]
    schema = StructType([*docs.select(*carried).schema.fields, *RESULTS])
    who, what = carried.index("doc_id"), carried.index("text")

    def runs(texts):
        """Runs of rows that hold about ``most_bytes``."""
        first, size = 0, 0
        for i, text in enumerate(texts):
            if i > first and size + len(text) > most_bytes:
                yield first, i
                first, size = i, 0
            size += len(text)
        yield first, len(texts)

    def transformed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(who).to_pylist(), [x or b"" for x in batch.column(what).cast(pa.binary()).to_pylist()]
            for a, b in runs(texts):
                columns = zip(*transform_texts(ids[a:b], texts[a:b], seed), strict=True)
                arrays = [pa.array(c, pa.string() if f.name in ("form", "output") else pa.int64()) for f, c in zip(RESULTS, columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *arrays], schema.names)

    return docs.select(*carried).mapInArrow(transformed, schema)


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` with the ``restored`` text, from ``output`` and ``form`` alone."""
    body = F.substring("output", F.lit(4), F.length("output"))
    before, after = lambda c, mark: F.split_part(c, F.lit(mark), F.lit(1)), lambda c, mark: F.split_part(c, F.lit(mark), F.lit(2))
    psm = F.concat(before(body, "<S>"), after(body, "<M>"), before(after(body, "<S>"), "<M>"))
    spm = F.concat(before(after(body, "<P>"), "<M>"), after(body, "<M>"), before(body, "<P>"))
    return outputs.withColumn("restored", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output")))


def op13_fim(spark, sf_dir):
    done = restore(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_HEX = lambda i: f"('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {8 * i + 1}, 8))::BIGINT"
SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u, {_HEX(0)} AS h1, {_HEX(1)} AS h2, {_HEX(2)} AS h3, {_HEX(3)} AS h4 FROM documents),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
x AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM x"""
