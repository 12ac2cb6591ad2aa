import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import AWKWARD, by_id, clash, docs, given

from tracelode.llm import byte_bpe, exact_dedup, exchange, host_quality, packing, substring_dedup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_rice_codes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 1000):
        for top in (8, 40, 63):
            values = np.unique(rng.integers(0, 1 << top, n, dtype=np.uint64))
            data = exchange.rice_encode(values) + b"rest"
            back, end = exchange.rice_decode(data)
            assert (back == values).all() and data[end:] == b"rest"


def brute_quality(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {p + k for at in grams.values() if len(at) > 1 for p in at for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    texts = AWKWARD + ["a b c a b c x", "a a a a", "# * | x\n# * | x", "b c d " * 3 + "e"]
    got = by_id(host_quality.judge(clash(docs(spark, texts))))
    for i, text in enumerate(texts):
        row = got[i]
        expected = brute_quality(text)
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert row["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])


def test_bad_host_is_condemned_and_others_are_not(spark):
    good = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(80)]
    texts = good + ["short"] * 60
    sources = ["fine"] * 40 + ["mixed"] * 38 + ["bad"] * 2 + ["bad"] * 58 + [None] * 2
    got = by_id(host_quality.judge(docs(spark, texts, sources=sources)))
    assert all(got[i]["kept"] for i in range(78))
    assert not any(got[i]["kept"] for i in range(78, 140)) and got[78]["host_condemned"] and not got[78]["base_failed"]
    assert not got[139]["host_condemned"]


def test_quality_of_nothing(spark):
    assert host_quality.judge(docs(spark, [])).collect() == []


def brute_windows(rows, width=13):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            g = tuple(w[i:i + width])
            if doc is not None:
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - width + 1):
            g = tuple(w[i:i + width])
            if g in first and (doc is None or first[g] < doc):
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk_bytes", [200, 1 << 20])
def test_substring_dedup_against_brute_force(spark, chunk_bytes, monkeypatch):
    rng = random.Random(5)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(n)] for n in (13, 14, 20, 60)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [str(rng.randrange(9)) for _ in range(rng.randrange(0, 20))] + rng.choice(passages)
        rows.append((i * 7, " ".join(w)))
    rows += [(None, rows[3][1]), (None, "only here " * 10), (7, rows[1][1]), (999, None), (998, "")]
    rows += [(2000 + i, t) for i, t in enumerate(AWKWARD)]
    rng.shuffle(rows)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(substring_dedup.chunked, "__defaults__", (chunk_bytes,))
    table = clash(docs(spark, [t for _, t in rows], [d for d, _ in rows]))
    result = substring_dedup.dedup(table).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in result), key=str) == brute_windows(rows)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in result)


def test_substring_dedup_on_given_rows(spark):
    rows = [(r.doc_id, r.text) for r in given(spark).collect()]
    result = substring_dedup.dedup(given(spark)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in result), key=str) == brute_windows(rows)
    assert substring_dedup.dedup(docs(spark, [])).collect() == []


def test_exact_dedup(spark):
    texts = AWKWARD + ["same  text", "same text", "same\ntext", "same text"]
    ids = list(range(len(texts) - 2)) + [None, 40]
    got = exact_dedup.duplicates(clash(docs(spark, texts, ids))).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    expected = []
    for i, n in zip(ids, norm, strict=True):
        group = [j for j, m in zip(ids, norm, strict=True) if m == n]
        keep = min(j for j in group if j is not None)
        expected.append((i, keep, len(group), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str) == sorted(expected, key=str)
    again = exact_dedup.duplicates(docs(spark, ["x", "x", "y", "y"], [1, 1, None, None])).collect()
    assert sum(r.kept for r in again) == 2 and len(again) == 4
    assert exact_dedup.duplicates(docs(spark, [])).collect() == []


def test_exact_dedup_of_one_id_with_two_texts(spark):
    got = exact_dedup.duplicates(docs(spark, ["x", "y", "x", "z"], [1, 1, 2, None])).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == sorted(
        [(1, 1, 2, True), (1, 1, 1, True), (2, 1, 2, False), (None, None, 1, True)], key=str)


def test_byte_bpe_is_as_tiktoken_does_it(spark):
    import tiktoken

    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(3)
    odd = ["".join(rng.choice("aé \n\t.'s1<|>  \x1c\x85中😀") for _ in range(200)) for _ in range(300)]
    texts = AWKWARD + odd + [r.text for r in given(spark).collect()] + ["a  b", " a", "a ", "\n a \n\n b", "don't  we'll 'S"]
    rows = byte_bpe.round_trip(clash(docs(spark, texts)), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = by_id(rows)
    for i, text in enumerate(texts):
        ids = reference.encode_ordinary(text or "")
        assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == ids, text
        assert bytes(got[i]["decoded"]) == (text or "").encode() and got[i]["n_tokens"] == len(ids)


def test_word_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, mine = Tokenizer.from_file(path), packing.WordIds(path)
    rng = random.Random(4)
    odd = ["".join(rng.choice("aé \n\t.'s1<|>  \x1c\x85中😀ΣİªÀÿŁ́'tLL") for _ in range(100)) for _ in range(300)]
    texts = [t or "" for t in AWKWARD] + odd + [r.text for r in given(spark).collect()]
    for text, ids in zip(texts, packing.token_ids(texts, mine), strict=True):
        assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0]


def lower_bound(histogram, capacity):
    total = sum(n * m for n, m in histogram.items())
    return max(-(-total // capacity), sum(m for n, m in histogram.items() if 2 * n > capacity))


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_length_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 2048
    top = [100, 700, 1100, 2049, 2049, 3][seed]
    lengths, counts = np.unique(rng.integers(1, top, [5, 50, 500, 5000, 50, 100000][seed]), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    made = packing.plan(histogram, capacity)
    used, taken = {}, {}
    for length, rank, count, sequence, offset in made.placed:
        assert taken.get(length, 0) == rank and count > 0
        taken[length] = rank + count
        for i in range(count):
            used.setdefault(sequence + i, []).append((offset, length))
    assert taken == histogram and len(used) == made.sequences
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert made.sequences <= lower_bound(histogram, capacity) * 1.03 + 1


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    texts = AWKWARD + [r.text for r in given(spark).collect()]
    rows = packing.pack(clash(docs(spark, texts)), path).collect()
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    seen = {}
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.start == r.piece * 2048 and len(part) == r.length <= 2048
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for places in seen.values():
        places.sort()
        assert [p[0] for p in places] == [sum(q[1] for q in places[:i]) for i in range(len(places))]
        assert sum(p[1] for p in places) <= 2048
    assert len(seen) <= 1.05 * lower_bound({r.length: 0 for r in rows} | _count(r.length for r in rows), 2048) + 1
    assert packing.pack(docs(spark, []), path).collect() == []


def _count(lengths):
    from collections import Counter

    return dict(Counter(lengths))
