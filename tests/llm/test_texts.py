"""Packing, fingerprints, token counts and byte-pair encoding against plain computations."""

import hashlib
import zlib

import numpy as np
import pytest

from inkwarden.llm import byte_pairs, fingerprints, packing, token_counts
from inkwarden.llm.encoders import encoding_of, tokenizer_file

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return encoding_of(tokenizer_file("byte_bpe_50k.tiktoken"), {packing.END_OF_TEXT: 50256})


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 3), (3, 2)):
        points = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        keys = packing.hilbert_keys(points, bits)
        assert sorted(keys) == list(range(len(points)))
        assert np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def packed_right(frame, texts, encoder):
    rows = frame.toPandas().sort_values(["sequence_id", "offset"])
    assert rows["doc_tokens"].where(rows["start"] == 0).sum() == sum(len(encoder.encode(t or "", allowed_special="all")) + 1 for _, t in texts)
    for _, part in rows.groupby("sequence_id"):
        assert (part["offset"] == part["length"].cumsum() - part["length"]).all()
        total = part["length"].sum()
        assert total <= 2048 and total & (total - 1) == 0  # no padding at all
    for doc_id, part in rows.groupby("doc_id"):
        same = [t for i, t in texts if i == doc_id]
        if len(same) == 1:
            ids = np.append(encoder.encode_to_numpy(same[0] or "", allowed_special="all"), 1).astype("<u4")
            at = 0
            for r in part.sort_values("start").itertuples():
                assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
                at += r.length
            assert at == len(ids)


def test_packing(spark, odd, none, encoder):
    from tokenizers import Tokenizer

    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    packed_right(packing.pack(odd), texts, encoder)
    assert packing.pack(none).count() == 0
    plain = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    for _, t in [*texts, (0, "a <|endoftext|> b\r\n\n  c")]:
        assert encoder.encode(t or "", allowed_special="all") == plain.encode(t or "", add_special_tokens=False).ids


def test_packing_query(spark, encoder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    packed_right(packing.op1_packing(spark, SMALL), docs, encoder)


def slow_marks(text, k, window):
    points = [ord(c) for c in text]
    hashes = [sum(p * pow(fingerprints.BASE, k - 1 - j, 1 << 64) for j, p in enumerate(points[i:i + k])) % (1 << 64)
              for i in range(len(points) - k + 1)]
    hashes = [int(h) >> 32 for h in fingerprints.mix(np.array(hashes, np.uint64))]
    places = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i:i + window]
        at = i + max(j for j, h in enumerate(part) if h == min(part))
        if not places or places[-1] != at:
            places.append(at)
    return [hashes[p] for p in places], places


@pytest.mark.parametrize("k,window", [(16, 32), (5, 4), (7, 10), (1, 1)])
def test_winnowing_matches_its_definition(k, window):
    for text in ("a" * 90, "abcabcabd" * 20, "It was the best of times, it was the worst of times. " * 3, "x" * k):
        hashes, places = fingerprints.marks(text, k, window)
        assert (hashes.tolist(), places.tolist()) == slow_marks(text, k, window)


def test_shared_passages_leave_common_marks():
    rng = np.random.default_rng(1)
    passage = "".join(rng.choice(list("abcdefgh "), 47))
    for _ in range(30):
        a, b = ("".join(rng.choice(list("abcdefgh "), 60)) + passage + "".join(rng.choice(list("abc "), 30)) for _ in range(2))
        assert fingerprints.likeness(fingerprints.marks(a)[0], fingerprints.marks(b)[0]) > 0


def follow(texts):
    rows = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for at, (i, t) in enumerate(rows):
        t, other = t or "", rows[(at + 1) % len(rows)][1] or ""
        edited = t[:len(t) - len(t) // 4] + other[:len(t) // 4]
        a, b, c = (fingerprints.marks(x)[0] for x in (t, edited, other))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.astype(">u4").tobytes().hex(),
                    b.astype(">u4").tobytes().hex(), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints_of_following_texts(spark, odd, none, parts):
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = fingerprints.compare_with_following(odd, parts)
    assert sorted(map(tuple, got.collect()), key=str) == follow(texts)
    assert fingerprints.compare_with_following(none, parts).count() == 0
    assert fingerprints.fingerprints(odd).where("size(hashes) <> size(positions)").count() == 0


def test_fingerprint_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, fingerprints.op2_fingerprints(spark, SMALL).collect()), key=str) == follow(docs)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(odd, none, rule):
    rows = token_counts.section_tokens(odd, rule=rule).toPandas()
    for doc_id, part in rows.groupby("doc_id"):
        text = next(r["text"] for r in odd.collect() if r["doc_id"] == doc_id)
        if doc_id != 6:
            assert part["tokens"].sum() == pytest.approx(part["doc_tokens"].iloc[0])
            assert part["start"].iloc[0] == 0 and part["end"].iloc[-1] == len(text)
            assert (part["start"].iloc[1:].to_numpy() == part["end"].iloc[:-1].to_numpy()).all()
    assert set(rows["doc_id"].dropna()) == {3, 4, 5, 6, 7, 8, 9, 10}
    assert token_counts.section_tokens(none, rule=rule).count() == 0


def test_allocation_of_crossing_tokens():
    first, end, bounds = np.array([0, 3, 4]), np.array([3, 6, 9]), np.array([0, 4, 5, 9])
    for rule, wanted in (("first", [2, 1, 0]), ("most", [2, 0, 1]), ("share", [1 + 1 / 3, 1 / 3 + 0.2, 1 / 3 + 0.8])):
        assert token_counts.allocate(first, end, bounds, rule)[0].tolist() == pytest.approx(wanted)
    with pytest.raises(ValueError):
        token_counts.section_tokens(None, rule="last")


def test_token_spans_follow_whole_characters(encoder):
    text = "a é 😀b"
    ids = encoder.encode_ordinary(text)
    sizes = np.array([len(encoder.decode_single_token_bytes(i)) for i in ids])
    first, end = token_counts.token_spans(text, sizes)
    whole = encoder.decode_with_offsets(ids)[1]
    assert first.tolist() == whole and end[-1] == len(text)


def test_token_count_query(spark):
    rows = token_counts.op5_token_counts(spark, SMALL).toPandas()
    sums = rows.groupby("doc_id").agg(tokens=("tokens", "sum"), whole=("doc_tokens", "first"))
    assert (sums["tokens"] == sums["whole"]).all() and len(sums) == 200


def digests(rows, encoder):
    out = {}
    for doc_id, text in rows:
        ids = encoder.encode_ordinary(text or "")
        out.setdefault(doc_id, set()).add((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                           hashlib.sha256((text or "").encode()).hexdigest()))
    return out


def test_byte_pairs(spark, odd, none, tmp_path):
    encoder = encoding_of(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    more = odd.select("doc_id", "text").unionAll(spark.createDataFrame(
        [(20, "don't we'LL  x  y\u0085z\r\n\n end "), (21, "日本語テキスト　です 123４５ ½²")], "doc_id bigint, text string"))
    more.write.parquet(f"{tmp_path}/documents.parquet")
    wanted = digests([tuple(r) for r in more.collect()], encoder)
    for got in (byte_pairs.op10_byte_pairs(spark, str(tmp_path)), byte_pairs.digests(more)):
        assert got.count() == more.count()
        for r in got.collect():
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) in wanted[r["doc_id"]]
    none.select("doc_id", "text").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert byte_pairs.op10_byte_pairs(spark, f"{tmp_path}/none").count() == 0


def test_byte_pair_query(spark):
    encoder = encoding_of(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    wanted = digests(docs, encoder)
    assert {r["doc_id"]: {tuple(r)[1:]} for r in byte_pairs.op10_byte_pairs(spark, SMALL).collect()} == wanted
    whole = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert {r["doc_id"]: {tuple(r)[1:]} for r in byte_pairs.digests(whole).collect()} == wanted


def test_folds_agree():
    ranks = byte_pairs.ranks_of(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    encoder = encoding_of(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    rng = np.random.default_rng(12)
    for n in (1, 2, 7, 30, 400, 3000):
        for letters in ("a", "ab", "etaoinshr"):
            word = "".join(rng.choice(list(letters), n))
            assert byte_pairs.fold(word.encode(), ranks) == byte_pairs.fold_long(word.encode(), ranks) == encoder.encode_ordinary(word)
