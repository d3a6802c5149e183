import hashlib
import json
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from tokenizers import Tokenizer

from tessera.llm import bpe as B
from tessera.llm import tokens

TEXTS = ["", None, " ", "a", "  a  b ", "It's  we'll\n\n x \t y", "end <|endoftext|> here<|endoftext|>", "naïve Größe 東京 🎉🎉 ½ Ⅷ ², x²", "a" * 9000, "ab" * 5000 + " " + "\n" * 300 + "z", "é" * 4000, "1" * 3000, "-" * 5000, "\x1c \x85 　x", " lead", "trail ", "word " * 4000, "ß​  q"]


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(B.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_encode_equals_library(lib):
    own = B.load(B.default_path())
    for t in TEXTS:
        want = lib.encode(t or "", add_special_tokens=False).ids
        got = own.encode(t)
        assert ids_of(got) == want, t
        assert own.decode(got) == lib.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aeslt.1<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encode_equals_library_on_any_text(text):
    lib = Tokenizer.from_file(B.default_path()) if not hasattr(test_encode_equals_library_on_any_text, "lib") else test_encode_equals_library_on_any_text.lib
    test_encode_equals_library_on_any_text.lib = lib
    own = B.load(B.default_path())
    want = lib.encode(text, add_special_tokens=False).ids
    assert ids_of(own.encode(text)) == want
    assert own.decode(own.encode(text)) == lib.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "aa", "ab", "the", "ing", "ti", "é", "0", "00", "--", "="]), min_size=2, max_size=200), st.integers(1, 9))
def test_tree_concatenation_is_exact(parts, leaf):
    own = B.load(B.default_path())
    piece = "".join(parts).encode()
    assert own.encode_unsplit(piece, leaf) == own._piece(piece)


def test_merges_are_reachable():
    """Every token's own merge is what its bytes come to, so ranks alone decide."""
    with open(B.default_path(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    rank = model["vocab"]
    for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
        parts, top = list(left + right), rank[left + right]
        while True:
            best = min(((rank.get(a + b, top), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(top, 0))
            if best[0] >= top:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert parts == [left, right]


def test_encode_documents(spark, lib):
    docs = spark.createDataFrame([Row(doc_id=i if i else None, text=t, ids=1) for i, t in enumerate([*TEXTS, TEXTS[3]])], "doc_id long, text string, ids long")
    got = {r.doc_id: r for r in tokens.encode_documents(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i if i else None]
        assert ids_of(r.ids) == lib.encode(t or "", add_special_tokens=False).ids and r.decoded == (t or "")
    assert tokens.encode_documents(docs.limit(0)).count() == 0


def test_slack_patterns_use_every_piece_once_and_are_full():
    rng = np.random.default_rng(4)
    counts = defaultdict(int)
    for n in rng.integers(1, 81, 3000):
        counts[int(n)] += 1
    bins = tokens.slack_patterns(counts, 100)
    used = defaultdict(int)
    for what, times in bins:
        assert 0 < sum(n * k for n, k in what) <= 100
        for n, k in what:
            used[n] += k * times
    assert used == counts
    bound = max(-(-sum(n * c for n, c in counts.items()) // 100), sum(c for n, c in counts.items() if n > 50))
    assert sum(t for _, t in bins) <= bound + 5
    assert tokens.slack_patterns({}, 100) == []
    # against exhaustive search: the first bin is as full as any that holds the largest
    for _ in range(30):
        some = rng.integers(1, 40, 8).tolist()
        c = defaultdict(int)
        for n in some:
            c[n] += 1
        rest = sorted(some, reverse=True)
        best = max(s for s in (rest[0] + sum(x for i, x in enumerate(rest[1:]) if m >> i & 1) for m in range(128)) if s <= 64)
        assert sum(n * k for n, k in tokens.slack_patterns(c, 64)[0][0]) == best


def check_pack(rows, texts, lib, cap):
    own = defaultdict(list)
    for r in rows:
        own[r.sequence_id].append(r)
    for seq in own.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= cap
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == cap or k == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    total = sum(r.length for r in rows)
    return len(own) - -(-total // cap)


def test_pack_minimum_slack(spark, lib):
    texts = [*TEXTS, *(f"w{i} " * (i * 7 % 300) for i in range(200)), *["same text"] * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for cap in (2048, 64):
        rows = tokens.pack_minimum_slack(tokens.document_pieces(docs, cap), cap).collect()
        assert check_pack(rows, texts, lib, cap) <= 1
    assert tokens.pack_minimum_slack(tokens.document_pieces(docs.limit(0))).count() == 0
    same = spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "doc_id long, text string")
    assert tokens.pack_minimum_slack(tokens.document_pieces(same)).count() == 3


def test_capacity_tree_finds_tightest():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 65, 700).tolist()
    bins = tokens.best_fit_decreasing(lengths, 64)
    plain, rooms = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [(r, b) for b, r in enumerate(rooms) if r >= lengths[i]]
        if fit:
            b = min(fit)[1]
            rooms[b] -= lengths[i]
        else:
            rooms.append(64 - lengths[i])
    assert sorted(64 - sum(lengths[i] for i in b) for b in bins) == sorted(rooms)
    assert sorted(i for b in bins for i in b) == list(range(700))
    assert tokens.best_fit_decreasing([], 64) == []


def test_pack_best_fit_is_lossless(spark, lib, tmp_path):
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    packed = tokens.pack_best_fit(docs, 256, buffer_tokens=3000)
    tokens.write_packed(packed, str(tmp_path / "packed"))
    parts = defaultdict(dict)
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        ids, pos = ids_of(r.ids), ids_of(r.positions)
        assert len(ids) == len(pos) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for d, k, s, a, b in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts[d][k] = (s, ids[a:b])
            assert pos[a:b] == list(range(b - a))
        assert ids[r.n_tokens :] == [0] * (256 - r.n_tokens)
    for i, t in enumerate(TEXTS):
        got = [x for k in sorted(parts[i if i else None]) for x in parts[i if i else None][k][1]]
        assert got == [*lib.encode(t or "", add_special_tokens=False).ids, 50256]
    assert tokens.pack_best_fit(docs.limit(0)).count() == 0


def test_buffer_is_packed_as_plain_best_fit_decreasing(spark, lib):
    """One task and one buffer: what is left in the bins is what a plain search for the tightest leaves."""
    rng = np.random.default_rng(11)
    words = ["alpha", "beta", "gamma", "delta"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 150))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    lengths = []
    for t in texts:
        n = len(lib.encode(t, add_special_tokens=False).ids) + 1
        lengths += [min(256, n - s) for s in range(0, n, 256)]
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, b) for b, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(256 - n)
    assert sorted(256 - r.n_tokens for r in tokens.pack_best_fit(docs, 256).collect()) == sorted(rooms)


def test_packers_with_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "one two", "p", 5, 7)] * 3 + [(2, None, "q", 6, 8), (None, "three", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, length int, sequence_id int")
    packed = tokens.pack_best_fit(docs).collect()
    assert sorted(str(d) for r in packed for d in r.doc_ids) == ["1", "1", "1", "2", "None"]
    slack = tokens.pack_minimum_slack(tokens.document_pieces(docs)).collect()
    assert sorted(str(r.doc_id) for r in slack) == ["1", "1", "1", "2", "None"] and len({(r.sequence_id, r.offset) for r in slack}) == 5


@pytest.mark.parametrize("flag", ["lstrip", "rstrip", "single_word"])
def test_added_tokens_of_another_kind_are_refused(tmp_path, flag):
    with open(B.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][0][flag] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="plain"):
        B.ByteBpe(str(tmp_path / "t.json"))
