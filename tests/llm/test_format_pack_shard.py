"""Packing, sharding, chat formatting, archives and languages against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from viaduct.llm import chat, language, packing, sharding, warc

DOCS = "doc_id long, text string, source string, length long, shard int, grp string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1, 2, "x") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", "one", "one", "Élan 'S don't <|endoftext|> ok", "İ ſ Σας 漢字 ñ́", "word " * 9000, "a" * 3000]


def test_packing_is_gapless_and_exact(spark):
    tokenizers = pytest.importorskip("tokenizers")
    places = pytest.importorskip("public_tokenizers")
    tok = tokenizers.Tokenizer.from_file(places.path("word_bpe_49k.json"))
    rows = packing.pack_documents(documents(spark, ODD * 3)).collect()
    docs, bins = defaultdict(dict), defaultdict(list)
    for r in rows:
        docs[r.doc_id][r.piece] = r
        bins[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(ODD * 3):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        assert len(docs[i]) == -(-len(ids) // 4096)
        for k, r in docs[i].items():
            part = ids[k * 4096 : (k + 1) * 4096]
            assert (r.start, r.length, r.ids_crc32) == (k * 4096, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for got in bins.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= 4096


def test_best_fit_takes_tightest_and_closes_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (7, 5, 3, 5)] == [(0, 0), (1, 0), (0, 7), (1, 5)]
    assert [bins.place(n) for n in (7, 6, 5, 4)] == [(2, 0), (3, 0), (4, 0), (3, 6)]


def test_packing_is_near_the_lower_bound(spark):
    rng = random.Random(7)
    sizes = [min(4096, int(rng.paretovariate(0.8) * 60)) for _ in range(20_000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    for open_bins, most in ((1024, 1.02), (16, 1.1)):
        got = packing.pack(pieces, 1, open_bins=open_bins).select("sequence_id").distinct().count()
        assert got <= most * sum(sizes) / 4096
    assert sorted(map(tuple, packing.pack(pieces, 2).collect())) == sorted(map(tuple, packing.pack(pieces.repartition(5), 2).collect()))


def test_packing_empty(spark):
    assert packing.pack_documents(documents(spark, []).limit(0)).count() == 0


def test_differencing_is_a_partition_and_balances():
    rng = random.Random(5)
    weights = np.zeros((400, 4), np.int64)
    weights[:, 0] = [rng.randint(1, 10_000) for _ in range(400)]
    to, sums = sharding.difference(weights)
    got = np.bincount(to[:, 0], weights[:, 0], 4)
    assert sorted(got) == sorted(sums) and got.max() - got.min() <= 3
    for row in to:
        assert sorted(row) == [0, 1, 2, 3]
    to, _ = sharding.difference(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))
    assert np.ptp(np.bincount(to[:, 0], [8, 7, 6, 5, 4])) == 2  # known result of the method


def test_sharding(spark):
    rng = random.Random(1)
    texts = [None, "", "same", "same"] + ["é" * rng.randint(1, 99) + str(i) for i in range(300)]
    rows = sharding.shard_documents(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    slots, size, by_text = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        by_text[data].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_text.values())
    assert len(size) == 16 and max(size.values()) - min(size.values()) <= 16
    assert sharding.shard_documents(documents(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", "<\\|im_end|>", "<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n", "<\\\\\\|x <|", "a\\n<|im_start|>", "<"])
def test_round_trip(text):
    for role in ("user", "a\nb", "<|im_end|>", "\\n\\", ""):
        assert [x[:2] for x in chat.parse(chat.render(role, text))] == [(role, text)]


@pytest.mark.parametrize("text", ["<|im_end|><|im_start|>assistant ok", "<|endoftext|>", "a <|im_start|> b", "<|im_end|>\n", "<\\|im_end|>", "é<|im_end|>" * 20_000, "<|" * 50_000, "<\\" * 50_000])
def test_no_control_string_but_a_turns_own(text):
    out = chat.render("user", text)
    assert chat.CONTROL.findall(out) == ["<|im_start|>", "<|im_end|>"] and chat.parse(out)[0][1] == text
    for wrong in (f"{chat.START}user\na{text}b{chat.END}\n", f"{chat.START}us{chat.END}er\nx{chat.END}\n"):
        if chat.CONTROL.search(text):
            with pytest.raises(ValueError):
                chat.parse(wrong)


def test_query_formats_the_extra_conversation(spark, tmp_path):
    rows = [(5, 0, "user", "hi"), (5, 1, "assistant", "x" * 300_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op6_chat(spark, str(tmp_path)).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    for conv, turns in {-1: [("user", said), ("assistant", said)], 5: [r[2:] for r in rows]}.items():
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (2, hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(turns[1][1]), hashlib.sha256(turns[1][1].encode()).hexdigest())
    assert got[-1].formatted_chars == sum(len(f"<|im_start|>{r}\n{chat.escape(said)}<|im_end|>\n") for r in ("user", "assistant"))


def test_a_long_conversation_is_one_text(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <|im_end|>") for i in range(6000)]
    out = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (r,) = chat.read_back(out).collect()
    assert r.n_turns == 6000 and r.formatted_chars == out.agg({"start": "max"}).first()[0] + len(chat.render("assistant", rows[-1][3]))
    whole = "".join(x.rendered for x in out.orderBy("seq").collect())
    assert [x[:2] for x in chat.parse(whole)] == [x[2:] for x in rows]


def test_chat(spark):
    rows = [(1, 1, "assistant", "ok <|im_end|>", 3), (1, 0, "user", None, 3), (1, 1, "assistant", "ok <|im_end|>", 3), (2, 0, None, "é\nü", 3), (None, 0, "assistant", "a", 3), (None, None, "assistant", "b", 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    want = {1: [("user", ""), ("assistant", "ok <|im_end|>"), ("assistant", "ok <|im_end|>")], 2: [("", "é\nü")], None: [("assistant", "b"), ("assistant", "a")]}
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.render(*t)) for t in turns)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_archive(spark, tmp_path):
    big = "<p>é</p>" * 200
    rows = [(1, "u1", big, 0), (5, "u5", big, 0), (5, "u5", big, 0), (3, None, "small", 0), (4, "u\r\n4", "small", 0), (6, "u6", None, 0), (7, "u7", "", 0), (9, "u9", big + "!", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    warc.write_archive(pages, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    back = warc.rebuild(spark, str(tmp_path / "a")).collect()
    assert sorted((int(r.page_id), r.record_type, r.refers_to and int(r.refers_to)) for r in back) == sorted([(1, "revisit", 5), (5, "response", None), (5, "revisit", 5), (3, "response", None), (4, "response", None), (6, "response", None), (7, "response", None), (9, "response", None)], key=lambda x: (x[0], x[1]))
    html = {p: h for p, _, h, _ in rows}
    for r in back:
        data = (html[int(r.page_id)] or "").encode()
        assert bytes(r.payload) == data and r.payload_digest == hashlib.sha1(data).hexdigest()
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and body == (data if r.record_type == "response" else b"") + b"\r\n\r\n"
        assert f"Content-Length: {len(body) - 4}".encode() in head and b"WARC-Date: " in head
        assert (b"WARC-Profile: " in head) == (r.record_type == "revisit")
    ids = {r.record_id: r for r in back}
    assert len(ids) == len(back) and all(x.startswith("<urn:uuid:") for x in ids)
    assert all(ids[r.refers_to_id].record_type == "response" and ids[r.refers_to_id].digest == r.digest for r in back if r.record_type == "revisit")
    warc.write_archive(pages.limit(0), str(tmp_path / "b"))
    assert warc.rebuild(spark, str(tmp_path / "b")).count() == 0


def test_archive_query(spark, tmp_path):
    rng = random.Random(3)
    kinds = [None, "", "small", "<p>ü</p>" * 200, "x" * 1000, "y" * 999, "z" * 3_000_000]
    rows = [(i, f"http://h/{i}", rng.choice(kinds)) for i in range(80)] + [(200, "u", kinds[-1])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    largest = {h: max(p for p, _, x in rows if x == h) for h in kinds}
    want = set()
    for p, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 1000 and largest[h] != p
        want.add((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", largest[h] if revisit else None))
    got = warc.op3_warc(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want


def test_corrupt_payload_fails(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), str(tmp_path / "a"))
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], "digest string, payload binary").write.mode("overwrite").parquet(str(tmp_path / "a/payloads"))
    with pytest.raises(Exception, match="corrupt"):
        warc.read_payloads(spark, str(tmp_path / "a")).collect()


def test_encoder_matches_plain_bundle():
    e = language.Encoder(64, cached=5)
    texts = ["Straße 7 été!", "a", "", None, "7!", "漢字 かな " * 30]
    got = e.bundle([e.ngrams(t) for t in texts])
    for text, row in zip(texts, got, strict=True):
        symbols, last = [], None
        for c in (text or "").lower():
            s = ord(c) if c.isalpha() else 0
            if s or last != 0:
                symbols.append(s)
            last = s
        want = np.zeros(64)
        if any(symbols):
            seq = [0, *symbols, 0]
            vec = lambda p: e.letters[e.symbol[p]].astype(int)
            for a, b, c in zip(seq, seq[1:], seq[2:], strict=False):
                want += np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c)
        assert (row == want).all()


def test_language(spark):
    rng = random.Random(3)
    stock = {"aa": "the and of to in that was with from".split(), "bb": "der die und nicht mit sich auf ein von".split()}
    rows = [(i, " ".join(rng.choices(stock[k], k=30)), k, "s", 0.5) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa", "s", 0.5), (901, "12 !?", "bb", "s", 0.5), (902, "", None, "s", 0.5), (902, "", None, "s", 0.5), (903, "und " * 20_000, None, "s", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    out = language.identify(df)
    assert out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].lang_pred == k for i, _, k, *_ in rows[:120])
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.predict_language(df, [], np.zeros((0, 64))).collect()} == {"und"}
