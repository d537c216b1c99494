"""Every operator against a plain computation, on rows with nulls, empty and long texts, ties,
repeated rows and clashing columns; and on no rows at all."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerframe.llm import (
    byte_bpe,
    common,
    fingerprints,
    language_id,
    near_dedup,
    packing,
    quality_rules,
    registered,
    sharding,
    suffix_dedup,
    token_counts,
    url_filter,
)

WORD, BYTE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row string, score string"


def words(rng, n, alphabet="abcdefghijklmnopq"):
    return [rng.choice(alphabet) + rng.choice(alphabet) + rng.choice(alphabet) for _ in range(n)]


def texts():
    rng = random.Random(3)
    base = words(rng, 120)
    edited = base[:60] + ["new"] + base[61:]
    passage = " ".join(words(rng, 60))
    long = " ".join(words(rng, 30_000))
    found = [
        " ".join(base),
        " ".join(edited),
        " ".join(base),
        None,
        "",
        "   \n\t",
        "short",
        "é漢字 ünï 12 <|endoftext|> it's  two\n\n\nlines\r\n",
        "a" * 300,
        "a" * 120 + "b",
        "same line of words\n" * 30,
        " ".join(words(rng, 40)) + " " + passage + "\n" + " ".join(words(rng, 50)),
        passage + " tail " + " ".join(words(rng, 200)),
        "äö" * 40 + passage,
        long,
        long[:100_000],
        " ".join(w.upper() + "!!" for w in words(rng, 80)),
        " | ".join(words(rng, 90)),
    ]
    return found + ["\n".join(" ".join(words(rng, 12)) for _ in range(9)) for _ in range(25)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "r", "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    # ids out of order, one id and one row repeated, one id missing
    found = [(1000 - 7 * i, t) for i, t in enumerate(texts())]
    return [*found, found[0], (found[1][0], "another text of a known id"), (None, "text without an id of its own")]


@pytest.fixture(scope="module")
def unique(rows):
    return rows[: len(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def unique_docs(spark, unique):
    return docs_of(spark, unique).repartition(3)


def test_token_counts(docs, rows):
    library = Tokenizer.from_file(WORD)
    got = sorted(tuple(r) for r in token_counts.token_counts(docs, WORD).collect() if r.doc_id is not None)
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows if i is not None)
    assert got == want


def odd_texts():
    rng = random.Random(9)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'re", "'", "!", "é", "漢", "7", "\x1c", "\x85", "　", "\x00", "<|endoftext|>", "́"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]


def test_pieces_are_encoded_as_whole_texts():
    odd = odd_texts()
    whole = Tokenizer.from_file(BYTE)
    for some in (odd, odd[7:8], ["", "", ""], [], [None, "a b", None][1:2], ["", " x\ny", ""]):
        packed = packing.encode_batch(BYTE, pa.array(some, pa.string()), 1)
        want = [[*e.ids, 1] for e in whole.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(p.as_py(), "<u2").tolist() for p in packed] == want
    # a slice of a batch, as batches of bounded bytes are
    part = packing.encode_batch(BYTE, pa.array(odd).slice(5, 20), 1)
    assert [p.as_py() for p in part] == [p.as_py() for p in packing.encode_batch(BYTE, pa.array(odd[5:25]), 1)]
    counts = [len(e.ids) for e in Tokenizer.from_file(WORD).encode_batch(odd, add_special_tokens=False)]
    assert token_counts.count_batch(WORD, odd) == counts


def test_byte_bpe_codes_as_the_library():
    codec = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    odd = [*odd_texts(), *[t for t in texts() if t]]
    for text, ids in zip(odd, codec.encode(odd), strict=True):
        ids = np.frombuffer(ids, "<i4")
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids)[0].tobytes() == text.encode()


def test_byte_bpe_frames(docs, rows):
    coded = byte_bpe.decoded(byte_bpe.encoded(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert collections.Counter(bytes(r.bytes) for r in coded) == collections.Counter((t or "").encode() for _, t in rows)


def test_perfect_hash_is_minimal():
    tokens = [f"t{i}".encode() for i in range(2000)]
    made = byte_bpe.PerfectHash(tokens)
    assert [made.index(t) for t in tokens] == list(range(2000)) and sorted(made.places) == list(range(2000))
    assert made.index(b"stranger") == -1


def test_packing_places_every_id_once(docs, rows):
    library = Tokenizer.from_file(BYTE)
    pieces = packing.packed(docs, BYTE, 1, length=256, group_docs=8).collect()
    want = collections.Counter(tuple([*library.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in rows)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length <= 256
        by_doc[p.doc_id, p.doc_tokens].append((p.start, ids))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    total = 0
    for own in by_sequence.values():
        offset = 0
        for start, length in sorted(own):
            assert start == offset
            offset += length
        assert offset <= 256
        total += offset
    assert total == sum(map(len, list(want.elements())))
    spelled = collections.Counter()
    for (_, n), own in by_doc.items():
        ids = [x for _, part in sorted(own) for x in part]
        if len(ids) == n:
            spelled[tuple(ids)] += 1
    # documents whose id and length are repeated can't be told apart here
    assert sum((want - spelled).values()) <= 2
    # a group of documents pads less than one sequence
    groups = -(-len(rows) // 8)
    assert len(by_sequence) * 256 - total < groups * 256


def test_packing_spreads_equal_rows(spark):
    # a third of all rows are equal, and have no id either
    made = [(None, "the same text again")] * 3000 + [(i, f"another text {i}") for i in range(6000)]
    pieces = packing.packed(docs_of(spark, made), BYTE, 1, length=64, group_docs=512).collect()
    groups = collections.Counter(p.sequence_id >> 32 for p in pieces if p.start == 0)
    assert sum(groups.values()) == 9000 and len(groups) == 18 and max(groups.values()) < 650
    of_equal = collections.Counter(p.sequence_id >> 32 for p in pieces if p.doc_id is None and p.start == 0)
    assert sum(of_equal.values()) == 3000 and max(of_equal.values()) < 300


def test_packing_of_short_texts_and_none(spark):
    pieces = packing.packed(docs_of(spark, [(1, None), (2, ""), (3, "x")]), BYTE, 1).collect()
    assert sorted((p.doc_id, p.start, p.length, p.doc_tokens) for p in pieces) == [(1, 0, 1, 1), (2, 0, 1, 1), (3, 0, 2, 2)]
    assert packing.packed(docs_of(spark, []), BYTE, 1).collect() == []


def test_pieces_that_nothing_spans_are_encoded_without_marks():
    """The same ids as one by one, from far fewer characters given to the library than with marks."""
    rng = random.Random(3)
    made = [" " + "".join(rng.choice("abé中7'sſ!") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    odd = ["x", "\n", "  two", " end\u3000", " a\x1c", " a\t", " <|endoftext|>", " a<b", " "]
    pieces = sorted({*made, *odd})
    known = Tokenizer.from_file(BYTE)
    want = {p: known.encode(p, add_special_tokens=False).ids for p in pieces}
    assert {p: np.frombuffer(ids, "<u2").tolist() for p, ids in packing.encoded_joined(BYTE, pieces)} == want
    given = []

    class Counting:
        normalizer = None

        def encode_batch_fast(self, texts, **more):
            given.extend(texts)
            return known.encode_batch_fast(texts, **more)

    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(packing, "tokenizer", lambda _: Counting())
        packing._id_bytes(BYTE)
        assert dict(packing.encoded_joined(BYTE, pieces)).keys() == want.keys()
    assert len(given) == 1 and len(given[0]) > 1000 and "<" not in given[0]


def test_known_results_are_asked_for_one_by_one():
    """A batch must not walk all results of the older generation."""

    class Unwalked(dict):
        def __iter__(self):
            raise AssertionError("walked")

    known = common.Recent(2, 9)
    known.now, known.before = {"a": 1}, Unwalked(b=2, c=3)
    assert sorted(known.unknown({"a", "b", "d"})) == ["d"] and known.now == {"a": 1, "b": 2}



def test_first_fit_takes_the_first_bin_with_room():
    rng = random.Random(1)
    tree, plain = packing.Tournament(40, 100), [100] * 40
    for _ in range(40):
        size = rng.randrange(1, 101)
        want = next(i for i, room in enumerate(plain) if room >= size)
        plain[want] -= size
        assert tree.first_fit(size) == want


def test_language_id(spark):
    rng = random.Random(2)
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "éèüöß"}
    made = [(i, " ".join(words(rng, 40, letters[lang])), lang) for i in range(90) for lang in letters]
    frame = spark.createDataFrame(made + [(1, None, "aa"), (2, "12 !!", None), (3, "", "bb")], "doc_id long, text string, lang string")
    model = language_id.train(frame.filter("doc_id < 60"))
    told = language_id.predicted(frame, model, "lang").collect()
    assert len(told) == len(made) + 3
    assert sum(r.lang_pred != "und" for r in told) == len(made)
    assert sum(r.lang_pred == r.lang for r in told) == len(made)
    assert all(0 <= r.score <= 1 for r in told)
    # neighbours in a batch don't matter
    alone, together = (language_id.scores(model, t)[1] for t in (["abc"], ["abc", "üß", "hij"]))
    assert alone[0] == together[0]


def test_language_id_with_nothing_learned(docs):
    assert language_id.train(docs.filter("false")) is None
    assert {r.lang_pred for r in language_id.predicted(docs, None).collect()} == {"und"}


def counts_of(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(zip(found, found[1:], found[2:], strict=False))
    covered = {i + d for i in range(len(found) - 2) if seen[tuple(found[i : i + 3])] > 1 for d in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows):
    named = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality_rules.counted(docs).select("text", *named).collect()
    assert len(got) == len(rows)
    assert [tuple(r)[1:] for r in got] == [counts_of(r.text) for r in got]


def test_quality_estimate_finds_the_accuracies():
    rng, patterns = random.Random(4), collections.Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        patterns[tuple((1 if (rng.random() < a) == good else -1) if rng.random() < 0.8 else 0 for a in (0.95, 0.9, 0.7, 0.85))] += 1
    weights = quality_rules.estimate(patterns, 4)
    assert abs(weights.prior - 0.8) < 0.03
    assert np.abs(np.array(weights.accuracies) - (0.95, 0.9, 0.7, 0.85)).max() < 0.04


def test_quality_posterior_column(spark):
    weights = quality_rules.Weights(0.7, tuple(0.6 + 0.03 * i for i in range(len(quality_rules.RULES))))
    patterns = [tuple(random.Random(i).choice((-1, 0, 1)) for _ in quality_rules.RULES) for i in range(30)]
    frame = spark.createDataFrame(patterns, quality_rules.RULES)
    for row in frame.withColumn("p", quality_rules.posterior(weights)).collect():
        assert abs(row.p - quality_rules.posterior_of(weights, tuple(row)[:-1])) < 1e-12


def removed_by_hand(rows):
    """By (ord, text): the bytes kept; windows of earlier ids only."""
    least = {}
    for number, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            window = data[i : i + 50]
            least[window] = min(least.get(window, number), number)
    found = []
    for number, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if least[data[i : i + 50]] < number:
                gone[i : i + 50] = True
        found.append((number, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return found


@pytest.mark.parametrize(("size", "bucket_rows"), [(suffix_dedup.CHUNK, suffix_dedup.BUCKET_ROWS), (300, 40), (64, 1_000_000)])
def test_suffix_dedup(docs, rows, size, bucket_rows):
    # small chunks: texts in parts, in every worker; small buckets: windows across borders
    order = lambda i: 2**63 - 1 if i is None else i
    want = sorted(removed_by_hand([(order(i), t) for i, t in rows]))
    cut = suffix_dedup.without_repeats(docs, size=size, bucket_rows=bucket_rows).collect()
    assert sorted((order(r.doc_id), bytes(r.bytes)) for r in cut) == want


def test_suffix_dedup_keeps_characters_whole(docs):
    whole = suffix_dedup.without_repeats(docs, whole_chars=True).collect()
    assert all(bytes(r.bytes).decode() is not None for r in whole)


@pytest.mark.parametrize("found", [["short", "", None, "short", "x" * 49], [None], ["   "]])
def test_suffix_dedup_of_texts_without_a_window(spark, found):
    made = list(enumerate(found))
    got = {r.doc_id: bytes(r.bytes) for r in suffix_dedup.without_repeats(docs_of(spark, made)).collect()}
    assert got == {i: (t or "").encode() for i, t in made}


@pytest.mark.parametrize("rest", [1, 10, 49, 50])
def test_suffix_dedup_of_last_parts_without_a_window(spark, rest):
    rng = random.Random(rest)
    long = "".join(rng.choice("abcdefgh") for _ in range(600 + rest))
    made = [(1, long), (2, "tail " + long[-80:]), (3, long[:200] + "!")]
    for size in (200, 300):
        got = {r.doc_id: bytes(r.bytes) for r in suffix_dedup.without_repeats(docs_of(spark, made), size=size).collect()}
        assert got == dict(removed_by_hand(made))


def test_bucket_of_keys():
    rng = np.random.default_rng(3)
    key = rng.integers(0, 2, (400, 76), np.uint8)
    key[:, :8] = rng.integers(0, 2, (400, 1), np.uint8)
    splitters = np.frombuffer(b"".join(sorted(bytes(k) for k in key[:9])), np.uint8).reshape(9, -1)
    want = [sum(bytes(s) <= bytes(k) for s in splitters) for k in key]
    assert suffix_dedup.bucket_of(key, splitters).tolist() == want
    assert suffix_dedup.bucket_of(key, None).tolist() == [0] * 400


def test_multikey_order():
    key = np.random.default_rng(0).integers(0, 2, (500, 26), np.uint8)
    order = suffix_dedup.multikey_order(key)
    assert [bytes(k) for k in key[order]] == sorted(bytes(k) for k in key)


def test_windows_across_buckets(spark):
    """One suffix with many fronts, in more buckets than one."""
    rng = random.Random(8)
    shared = " ".join(words(rng, 30))
    made = [(i, " ".join(words(rng, 20)) + " " + shared + " " + " ".join(words(rng, 20))) for i in range(300)]
    got = {r.doc_id: bytes(r.bytes) for r in suffix_dedup.without_repeats(docs_of(spark, made).repartition(5)).collect()}
    assert got == dict(removed_by_hand(made))


def test_fingerprints(unique_docs, unique):
    got = {r.doc_id: r for r in fingerprints.fingerprints(unique_docs, cells=6).collect()}
    order = sorted(unique, key=lambda r: -r[0])
    for i, (number, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        row = got[number]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, row.near_edited), (after, row.near_next)):
            one, two = (set(re.findall(r"[^\n]{1,128}", t)) for t in (text, other))
            assert near == (2 * len(one & two) / (len(one) + len(two)) if one or two else 1.0)
    prints = {}
    for number, text in unique:
        assert prints.setdefault(text or "", got[number].fingerprint) == got[number].fingerprint


def test_fingerprints_of_repeated_rows(docs, rows):
    assert fingerprints.fingerprints(docs).count() == len(rows)


def test_sharding(spark, docs, rows):
    records = sharding.sized(docs)
    sizes = sharding.slot_bytes(records)
    dealt = sharding.first_map(sizes, 4)
    placed = sharding.sharded(records, sharding.versions(spark, [dealt]), 0).collect()
    assert len(placed) == len(rows)
    assert collections.Counter((r.size, r.text_crc32) for r in placed) == collections.Counter(
        (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows
    )
    by_shard = collections.defaultdict(list)
    for r in placed:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def spark_slot(doc_id):
    """The slot of an id, by the hash's published definition: xxh64 with seed 42 over eight bytes."""
    return xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42) % sharding.SLOTS


def test_sharding_equals_plain_dealing(spark, tmp_path):
    rng = random.Random(16)
    rows = [(i * 7 + 1, "x" * rng.randrange(0, 300)) for i in range(4000)] + [(50_000, None), (50_001, ""), (50_002, "y" * 30_000)]
    records = sharding.sized(spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("size", F.lit("clash")))
    path = str(tmp_path / "map")
    assert sharding.rebalance(records, path, sharding.deal(records, path, 4), 4) == 1
    got = sharding.sharded(records, sharding.stored(spark, path), 1).collect()
    size = {i: len(t or "") + 16 for i, t in rows}
    slots = collections.Counter()
    for i in size:
        slots[spark_slot(i)] += size[i]
    loads, owner = [0] * 4, {}
    for slot in sorted(range(sharding.SLOTS), key=lambda s: (-slots[s], s)):
        owner[slot] = loads.index(min(loads))
        loads[owner[slot]] += slots[slot]
    assert {(r.doc_id, r.size, r.virtual_slot, r.shard) for r in got} == {(i, size[i], spark_slot(i), owner[spark_slot(i)]) for i in size}
    place = collections.Counter()
    expected = {}
    for i in sorted(size):
        expected[i] = place[owner[spark_slot(i)]]
        place[owner[spark_slot(i)]] += 1
    assert {r.doc_id: r.slot for r in got} == expected
    assert sharding.stored(spark, path).groupBy("version").count().count() == 2
    with pytest.raises(AnalysisException):
        sharding.store(spark, path, 1, owner)


def test_sharding_spreads_missing_and_shared_ids(spark, tmp_path):
    """A third of the rows has no id and a third has one id: bytes are even all the same."""
    rows = [(i if i % 3 == 0 else None if i % 3 == 1 else 5, "z" * (i % 50)) for i in range(9000)]
    records = sharding.sized(spark.createDataFrame(rows, "doc_id long, text string"))
    path = str(tmp_path / "map")
    version = sharding.rebalance(records, path, sharding.deal(records, path, 8), 8)
    maps = sharding.stored(spark, path)
    marked = {r.virtual_slot for r in maps.filter("spread").collect()}
    assert len(marked) == 2 and spark_slot(5) in marked
    got = sharding.sharded(records, maps, version).collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((i, len(t) + 16) for i, t in rows)
    loads, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
        if r.doc_id is not None and spark_slot(r.doc_id) not in marked:
            assert r.virtual_slot == spark_slot(r.doc_id)
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) < 0.01 * sum(loads.values()) / 8
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


def test_sharding_of_no_rows(spark, tmp_path):
    records = sharding.sized(spark.createDataFrame([], "doc_id long, text string"))
    path = str(tmp_path / "map")
    version = sharding.rebalance(records, path, sharding.deal(records, path, 4), 4)
    assert sharding.sharded(records, sharding.stored(spark, path), version).count() == 0


def test_sharding_rebalances_few_slots():
    rng = random.Random(6)
    sizes = {slot: rng.randrange(1, 1000) for slot in range(sharding.SLOTS)}
    dealt = sharding.first_map(sizes, 10)
    loads = collections.Counter()
    for slot, shard in dealt.items():
        loads[shard] += sizes[slot]
    assert max(loads.values()) - min(loads.values()) <= 1000
    grown = sharding.rebalanced(dealt, sizes, 11)
    moved = [slot for slot in dealt if grown[slot] != dealt[slot]]
    assert all(grown[slot] == 10 for slot in moved)
    after = collections.Counter()
    for slot, shard in grown.items():
        after[shard] += sizes[slot]
    assert max(after.values()) - min(after.values()) < 0.02 * sum(sizes.values()) / 11
    fewer = sharding.rebalanced(dealt, sizes, 9)
    assert set(fewer.values()) == set(range(9))


def test_url_filter(spark):
    urls = [None, "no scheme", "http://A.Example.ORG/es/x", "http://example.org", "https://b.org/?q=1", "ftp://x.COM/fr/1#t", "http://x.com/de/", "http://listed.net/a", "http://deep.listed.net", "http://unlisted.net/"]
    urls += [f"http://h{i}.{'bad' if i % 9 == 0 else 'ok'}{i}.net/p" for i in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    blocked = spark.createDataFrame([("listed.net",), *((f"bad{i}.net",) for i in range(0, 400, 9))], "domain string")
    for limit in (64 << 20, 300):
        got = {r.page_id: r for r in url_filter.url_filter(pages, registered.URL_RULES, blocked, limit).collect()}
        assert len(got) == len(urls)
        told = [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(10)]
        assert told == [
            ("", "", None, "allow"),
            ("", "", None, "allow"),
            ("a.example.org", "/es/x", "example.org/es/", "block"),
            ("example.org", "", None, "allow"),
            ("b.org", "/", "org/", "allow"),
            ("x.com", "/fr/1", "com/fr/", "allow"),
            ("x.com", "/de/", "com/de/", "block"),
            ("listed.net", "/a", None, "block"),
            ("deep.listed.net", "", None, "block"),
            ("unlisted.net", "/", None, "allow"),
        ]
        assert all((got[10 + i].verdict == "block") == (i % 9 == 0) for i in range(400))


def test_near_dedup(docs, rows, monkeypatch):
    got = near_dedup.near_classes(docs).collect()
    assert len(got) == len(rows)
    names = {r.row: r["class"] for r in got}
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(names[r.row])
    alike = lambda a, b: bool(by_id[a] & by_id[b])
    assert alike(1000, 993) and alike(1000, 986)  # an edit, a copy
    assert alike(979, 972) and not alike(1000, 979)  # no text; other text
    assert not alike(1000 - 7 * 11, 1000 - 7 * 12)  # a shared passage only


def test_near_dedup_compares_the_rest_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    shared = words(rng, 60)
    families = [words(rng, 10) for _ in range(40)]
    made = [(i, " ".join(shared + families[i % 40] + [f"x{i}"])) for i in range(80)]
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    got = {r.doc_id: r["class"] for r in near_dedup.near_classes(docs_of(spark, made)).collect()}
    assert all(got[i] == got[i + 40] for i in range(40))


def test_near_dedup_joins_copies_by_an_original_that_is_no_leader(spark):
    """Copies unlike each other, all like one document that is the last of its buckets."""
    rng = random.Random(11)
    base = words(rng, 300)
    made = [(1000, " ".join(base))]
    for i in range(60):
        edited = list(base)
        for place in rng.sample(range(2, 298, 6), 9):
            edited[place] = f"x{i}"
        made.append((i, " ".join(edited)))
    own = [near_dedup.labels(t) for _, t in made]
    assert all(near_dedup.similarity(own[0], o) >= 0.8 for o in own[1:])
    assert sum(near_dedup.similarity(own[1], o) >= 0.8 for o in own[2:]) == 0
    got = {r.doc_id: r["class"] for r in near_dedup.near_classes(docs_of(spark, made)).collect()}
    assert set(got.values()) == {0}


def test_near_dedup_finds_all_alike_short_texts(spark):
    """Texts that differ at an end by as much as 0.8 leaves, of every length with keys."""
    rng = random.Random(12)
    made, alike = [], []
    for shingles in range(5, 26):
        for _ in range(6):
            text = words(rng, shingles + 4)
            fewer = next(k for k in range(shingles, 0, -1) if (k - 1) / shingles < 0.8)
            alike.append((len(made), len(made) + 1))
            made += [" ".join(text), " ".join(text[: fewer + 4])]
            if shingles < 10:
                alike.append((len(made), len(made) + 1))
                made += [" ".join(["a", *text[1:]]), " ".join(["b", *text[1:]])]
    own = [near_dedup.labels(t) for t in made]
    for i, j in alike:
        assert near_dedup.similarity(own[i], own[j]) >= 0.8
        if min(len(own[i]), len(own[j])) <= near_dedup.FEW:
            assert set(near_dedup.candidacies(own[i]).tolist()) & set(near_dedup.candidacies(own[j]).tolist())
    few = range(60)
    got = {r.doc_id: r["class"] for r in near_dedup.near_classes(docs_of(spark, [(i, made[i]) for i in few])).collect()}
    assert all(got[i] == got[j] for i, j in alike if j in few)


def test_similarity_is_a_chain_in_order():
    rng = random.Random(7)
    one = near_dedup.labels(" ".join(words(rng, 400)))
    assert near_dedup.similarity(one, one) == 1
    two = one.copy()
    two[100:140] = np.arange(40, dtype=np.uint64)
    assert near_dedup.similarity(one, two) == (len(one) - 40) / len(one)
    assert near_dedup.similarity(one, np.concatenate([one[200:], one[:200]])) == 0
    swapped = one.copy()
    swapped[[10, 11]] = swapped[[11, 10]]
    assert near_dedup.similarity(one, swapped) == (len(one) - 1) / len(one)


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (500, 40), (500, 30)]
    known = near_dedup.components(spark.createDataFrame(links, "leader long, row long"))
    found = {r.node: r.label for r in known.collect()}
    assert found == {**dict.fromkeys(range(31), 0), 40: 0, 500: 0, 100: 100, 101: 100, 102: 100}


def test_pipeline_stages(spark, docs):
    own = set(docs.columns)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert set(kept.columns) == own
    left = {r.doc_id: r.text for r in kept.collect()}
    assert 1000 in left or 993 in left or 986 in left
    assert len({1000, 993, 986} & set(left)) == 1
    assert 979 not in left and 972 not in left and 1000 - 7 * 16 not in left and 1000 - 7 * 17 not in left
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
    assert {p.doc_id for p in pieces} == set(left)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_empty_tables(spark, name, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert registered.queries()[name](spark, str(tmp_path)).collect() == []


def test_url_filter_of_few_listed_among_many(spark):
    """The second level is larger than the first; a group that comes out too large is split."""
    pages = spark.range(20_000).selectExpr("id as page_id", "concat('http://h', id, '.test/') as url")
    blocked = spark.createDataFrame([(f"h{i}.test",) for i in range(0, 20_000, 2000)], "domain string")
    got = url_filter.url_filter(pages, [], blocked, limit=100)
    assert {r.page_id for r in got.filter("listed").collect()} == set(range(0, 20_000, 2000)) and got.count() == 20_000


def test_every_language_is_sampled(spark):
    """All texts of one language are the same, and another is rare."""
    rng = random.Random(2)
    made = [(i, "wiederholter text in einer sprache", "de") for i in range(3000)]
    made += [(3000 + i, " ".join(words(rng, 20, "abcdef")), "xa") for i in range(3000)]
    made += [(6000 + i, " ".join(words(rng, 20, "uvwxyz")), "xu") for i in range(12)]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language_id.train(frame, sample_docs=100)
    assert model.languages == ["de", "xa", "xu"]
    told = language_id.predicted(frame, model, "lang").filter("lang <> lang_pred").count()
    assert told <= 60
    assert language_id.even_share([5, 1, 100], 20) == 14 and language_id.even_share([3, 3], 100) == 3


def test_pipeline_of_documents_without_languages(spark):
    rng = random.Random(3)
    made = [(i, ". ".join(" ".join(words(rng, 9)).capitalize() for _ in range(12)), None, "s", 1) for i in range(20)]
    frame = spark.createDataFrame([*made, (99, "12 34", None, "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.languages(spark, frame, "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(20)) and list(kept[0].asDict()) == frame.columns
