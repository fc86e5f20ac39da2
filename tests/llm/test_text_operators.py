"""Word-based operators against plain Python versions, on small tables with odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses, mixing, ngram_join, packing, quality, sharding, token_file, tokens
from tessera.llm.components import components

WORD = "[^\x20\x09-\x0d]+"
ODD = [None, "", " ", "a", "A b", " x  y\tz\x0bq\n", "é É", "\n\na\na\n\na", "a a a a", "x|y\r\nx|y\r\n", "<|endoftext|>mid <|startoftext|>", "word " * 3000, "日本語。テスト"]


@pytest.fixture(scope="module")
def docs(spark):
    """Prose with near copies of all degrees, exact copies, odd texts, a null id and clashing columns."""
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choices("abcdeéfgh", k=rnd.randint(2, 7))) for _ in range(900)]
    rows, texts = [], list(ODD)
    for _ in range(40):
        words = rnd.choices(vocabulary, k=rnd.choice([3, 6, 30, 120, 700]))
        base = " ".join(w.capitalize() if i % 9 == 0 else w + ("." if i % 9 == 8 else "") for i, w in enumerate(words)) + "."
        texts.append(base)
        for _ in range(rnd.choice([0, 1, 12])):
            edited = list(words)
            for _ in range(rnd.choice([0, 1, 1, 3, 8])):
                edited[rnd.randrange(len(edited))] = rnd.choice(vocabulary)
            texts.append(" ".join(edited) if rnd.random() < 0.8 else base)
    for i, t in enumerate(texts):
        rows.append((i * 3 % 1009 if i != 15 else None, t, rnd.choice(["s1", "s2", "é", None]), i, "x"))
    rows.append(rows[20])
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, kept string").repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def words(text):
    return re.findall(WORD, text or "")


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_quality_base_figures(docs, empty):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.figures(docs).collect()}
    want = set()
    for r in docs.collect():
        w = words(r["text"])
        seen, dup = set(), 0
        for line in (r["text"] or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        found = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {k for i in range(len(w) - 2) if found[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        want.add((r["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r["text"] or ""), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert got == want
    assert quality.figures(empty).count() == 0


def plain_quality(text):
    """Kept or not, and the cleaned text, line by line with plain strings."""
    text = text or ""
    w, found = words(text), Counter()
    for i in range(len(w) - 2):
        found[tuple(w[i : i + 3])] += 1
    repeated = {k for i in range(len(w) - 2) if found[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    seen, left, lost = set(), [], 0
    for line in text.split("\n"):
        own = words(line)
        if not own:
            left.append(line)
            continue
        ended = [x.endswith((".", "!", "?", ":", ";", '"', "'", ")", "]", "}", "。", "！", "？", "…", "”", "»")) for x in own]
        size = sum(map(len, own))
        symbols = sum(c in "#*$%&|<>" for c in line)
        shouts = sum(x.endswith("!!") and len(x.encode()) > 2 for x in own)
        separators = sum(x in ("|", ">", "/", "-") for x in own)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
        bad = 10 * symbols > size or 2 * shouts > len(own) or not (ended[-1] or len(own) >= 8 and any(ended))
        bad |= separators >= 2 and 5 * separators >= len(own)
        bad |= line in seen or len(own) <= 15 and any(p in low for p in quality.PHRASES)
        seen.add(line)
        if bad:
            lost += size
        else:
            left.append(line)
    kept = len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and 100 * lost <= 50 * sum(map(len, w))
    return kept, "\n".join(left)


def test_quality_verdict_and_cleaned_text(docs, spark):
    rnd = random.Random(9)
    parts = ["word", "Ende.", "fin!", "ÉTÉ", "buy!!", "ab|cd", "|", ">", "-", "###", "Click here", "haut de page", "“so”", "日本。", "a", "naïve", "x" * 30, "(etc)"]
    made = ["\n".join(" ".join(rnd.choices(parts + [f"v{rnd.randint(0, 300)}" for _ in range(60)], k=rnd.choice([0, 1, 5, 9, 14, 40]))) + rnd.choice(["", ".", " ", "\r"]) for _ in range(rnd.randint(1, 25))) for _ in range(500)]
    made += [made[3] + "\n" + made[3], "\n\n", *ODD]
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts = made + real + [r["text"] for r in docs.collect()]
    table = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    want = {i: plain_quality(t) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["kept"] for r in quality.figures(table).collect()}
    assert got == {i: k for i, (k, _) in want.items()} and 100 < sum(got.values()) < len(got)
    cleaned = {r["doc_id"]: (r["text"], r["n_chars"]) for r in quality.clean(table).collect()}
    assert cleaned == {i: (t, len(t)) for i, (k, t) in want.items() if k}


def test_quality_of_a_very_long_text(spark):
    rnd = random.Random(2)
    line = lambda: " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(12)) + "."
    long = "\n".join(line() for _ in range(40_000)) + "\nHome | Shop | Contact"
    rows = quality.figures(spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_words"], r["kept"], r["n_lines_removed"]) for r in rows} == {(1, 480_005, True, 1), (2, 1, False, 1)}


def test_quality_keeps_prose_and_rejects_junk(spark):
    rnd = random.Random(1)
    prose = "\n".join(" ".join("".join(rnd.choices("abcdefg", k=5)) for _ in range(12)).capitalize() + "." for _ in range(10))
    menu = "\n".join(" | ".join("".join(rnd.choices("abcdefg", k=5)) for _ in range(12)) for _ in range(10))
    shout = " ".join("".join(rnd.choices("ABCDEFG", k=5)) + "!!" for _ in range(100))
    mixed = prose + "\nHome | Shop | Contact | Login\nPlease click here to accept cookies\n"
    rows = {r["doc_id"]: r for r in quality.figures(spark.createDataFrame(list(enumerate([prose, menu, shout, mixed])), "doc_id long, text string")).collect()}
    assert [rows[i]["kept"] for i in range(4)] == [True, False, False, True]
    out = {r["doc_id"]: r for r in quality.clean(spark.createDataFrame([(0, prose, 9), (3, mixed, 9)], "doc_id long, text string, n_chars long")).collect()}
    assert out[0]["text"] == prose and out[3]["text"] == prose + "\n" and out[3]["n_chars"] == len(prose) + 1


@pytest.mark.parametrize(("small", "exact", "hot"), [(None, False, False), (0, False, False), (60, False, True), (None, True, False), (0, True, True)])
def test_ngram_join_finds_every_group(docs, empty, small, exact, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 7)
    if hot:  # nearly every list is dealt out as a hot one
        monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    rows = docs.collect()
    sets = {i: shingles(r["text"]) for i, r in enumerate(rows)}
    group = list(range(len(rows)))
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((rows[i]["doc_id"] for i in sets if group[i] == g and rows[i]["doc_id"] is not None), default=None) for g in set(group)}
    want = sorted((str(r["doc_id"]), len(sets[i]), str(least[group[i]] if sets[i] else r["doc_id"])) for i, r in enumerate(rows))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.groups(docs, small=small, exact=exact).collect())
    assert got == want
    if small is None and not exact:
        assert ngram_join.groups(empty).count() == 0
        kept = ngram_join.one_of_each(docs)
        assert kept.columns == docs.columns
        named = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None and shingles(r["text"])]
        assert sorted(named) == sorted({v for g, v in least.items() if v is not None and any(sets[i] and group[i] == g for i in sets)})


@pytest.mark.parametrize("tile", [2048, 5])
def test_ngram_join_counts_every_link(docs, empty, spark, tile, monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNT_TILE", tile)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    near = []
    for i in range(60):  # different texts that meet in long lists, nearly all of them linked with each other
        words = list(base)
        for _ in range(i % 4):
            words[rnd.randrange(200)] = f"x{i}"
        near.append((5000 + i, " ".join(words) + f" y{i}"))
    table = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    rows = table.collect()
    sets = [shingles(r["text"]) for r in rows]
    want = []
    for i, s in enumerate(sets):
        n = sum(1 for j, t in enumerate(sets) if i != j and s and t and 100 * len(s & t) >= 75 * len(s | t))
        want.append((str(rows[i]["doc_id"]), len(s), n))
    assert max(n for *_, n in want) > 50
    got = [(str(r["doc_id"]), r["n_shingles"], r["n_links"]) for r in ngram_join.groups(table).collect()]
    assert sorted(got) == sorted(want)
    assert ngram_join.groups(empty).columns == ["doc_id", "n_shingles", "n_links", "component_id"]


def test_one_of_each_judges_each_text_of_an_id(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base, "a"), (5, base + " more", "b"), (5, "quite another text that belongs to no group at all", "c"), (5, "", "d"), (6, base + " less", "e"), (7, "alone but for the id and so it stays", "f"), (7, "alone but for the id and so it stays", "f"), (None, base, "g")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = ngram_join.one_of_each(table)
    assert kept.columns == table.columns
    assert sorted(r["source"] for r in kept.collect()) == ["a", "c", "d", "f", "g"]


def test_components_with_and_without_rounds(spark, monkeypatch):
    from tessera.llm import components as module

    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 103)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    want = {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 103, 200: 103}
    for size in (1000, 9):
        monkeypatch.setattr(module, "PART_LINKS", size)
        assert {r["v"]: r["root"] for r in components(df).collect()} == want


def library(name, texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_odd_white_space_does_not_change_ids(name):
    import pyarrow as pa

    rnd = random.Random(11)
    parts = ["a", "B", "e\u0301", "é", "Σ", "ß", "İ", "가", "一", "3", "½", " ", "  ", "\n", "\t", "\r\n", "\u2003", "\u3000", "\u00a0", "\x85", "\x1c", "\u200b", "\ufeff", ",", ".", "'s", "!", "<|endoftext|>", "<|", "|>", "ing", "\u0301", "😀", "\x0b"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(8000)] + [None, ""]
    want = library(name, texts)
    for size in (tokens.GROUP_BYTES, 3000, 12):
        got = []
        for first, flat, bounds in tokens.encode(pa.array(texts), name, group_bytes=size):
            assert first == len(got)
            got += [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == want


def test_very_long_texts(spark):
    """Ten megabytes in one text, with blank lines, and two without any place to cut."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdeéfgh", k=rnd.randint(2, 9))) for _ in range(5000)]
    long = "\n\n".join(" ".join(rnd.choices(vocabulary, k=200)) + "." for _ in range(8000))
    assert len(long.encode()) > 10_000_000
    texts = [long, "x" * 300_000, "é" * 100_000, None, "short"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in (tokens.BYTE_BPE, tokens.WORD_BPE):
        want = {i: len(ids) for i, ids in enumerate(library(name, texts))}
        assert {r["doc_id"]: r["n_tokens"] for r in tokens.counts(table, name).collect()} == want
    ids = library(tokens.BYTE_BPE, texts)
    assert {r["doc_id"]: r["n_tokens"] for r in token_file.round_trip(table).collect()} == {i: len(x) + 1 for i, x in enumerate(ids)}
    packed = packing.pack_documents(table).collect()
    assert sum(r["length"] for r in packed) == sum(len(x) + 1 for x in ids)
    assert len({r["sequence_id"] for r in packed}) == -(-sum(len(x) + 1 for x in ids) // 1024)


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_token_counts_equal_the_library(docs, empty, name):
    rnd = random.Random(3)
    parts = ["a", "B", "é", "é", " ", "\n", "  ", "\t", "don't", "'s", "12", ", ", ". ", ".\n", "...", "<|endoftext|>", "<|", "日本", "ß", "İ", "!", " ", "\r\n", "Word", "_", "😀", " "]
    odd = docs.sparkSession.createDataFrame([(i, "".join(rnd.choices(parts, k=rnd.randint(0, 9)))) for i in range(3000)], "doc_id long, text string")
    for table in (docs.select("doc_id", "text"), odd):
        rows = table.collect()
        want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(i), len(i) > 2048) for r, i in zip(rows, library(name, [r["text"] for r in rows]), strict=True))
        for size in (tokens.GROUP_BYTES, 500, 7):
            got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.counts(table, name, group_bytes=size).collect())
            assert got == want
    assert tokens.counts(empty, name).count() == 0


def test_token_file_round_trip(docs, empty):
    table = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(table.collect(), key=lambda r: r["doc_id"])
    want, start = [], 0
    for r, ids in zip(rows, library(tokens.BYTE_BPE, [r["text"] for r in rows]), strict=True):
        raw = b"".join(i.to_bytes(4, "little") for i in [*ids, 0])
        want.append((r["doc_id"], start, len(ids) + 1, zlib.crc32(raw)))
        start += len(ids) + 1
    assert sorted(map(tuple, token_file.round_trip(table).collect())) == want
    assert token_file.round_trip(empty).count() == 0


def test_packing_keeps_the_contract(docs, empty):
    rows = packing.pack_documents(docs, with_ids=True).collect()
    texts = docs.collect()
    lengths = sorted(len(i) + 1 for i in library(tokens.BYTE_BPE, [r["text"] for r in texts]))
    assert sum(r["length"] for r in rows) == sum(lengths)
    bins = {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        assert r["piece"] == 0 or r["length"] == 1024
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    counts = Counter(r["length"] for r in rows)
    assert len(bins) <= len(best_fit(counts.elements(), 1024))
    assert packing.pack_documents(empty).count() == 0


def best_fit(lengths, capacity):
    """Plain best-fit decreasing, piece by piece: what each sequence has left."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [x for x in left if x >= n]
        if fits:
            left.remove(min(fits))
        left.append((min(fits) if fits else capacity) - n)
    return left


def test_packing_is_never_worse_than_best_fit(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    sizes = [len(i) + 1 for i in library(tokens.BYTE_BPE, texts)]
    whole = Counter(x for n in sizes for x in [1024] * ((n - 1) // 1024) + [(n - 1) % 1024 + 1])
    rnd = random.Random(6)
    cases = [(whole, 1024)] + [(Counter(rnd.choices(range(1, c + 1), k=rnd.randint(1, 400))), c) for c in (16, 64, 200) for _ in range(15)]
    for counts, capacity in cases:
        got = sum(k for _, k in packing.plan(dict(counts), capacity))
        assert -(-sum(n * k for n, k in counts.items()) // capacity) <= got <= len(best_fit(counts.elements(), capacity))
    assert sum(k for _, k in packing.plan(dict(whole))) <= 964


def test_complement_index_stays_true():
    import numpy as np

    rnd = random.Random(3)
    have = np.array([0] + [rnd.randint(0, 2) for _ in range(50)])
    index = packing.Complements(have)
    for x in rnd.sample([k for k in range(51) if have[k]], 25):
        index._gone(x)
        assert (index.pairs == np.convolve(index.one, index.one)[:51]).all()
        assert (index.triples == np.convolve(np.convolve(index.one, index.one), index.one)[:51]).all()


def test_packing_takes_clashing_names(spark):
    items = spark.createDataFrame([(i, i % 7 + 1, i, i, i) for i in range(50)], "doc_id long, length long, __bucket int, __rank int, __before int")
    rows = packing.pack(items, ["doc_id"], 16).collect()
    assert len(rows) == 50 and all(r["__rank"] == r["__bucket"] == r["doc_id"] for r in rows)


def test_packing_plan_uses_exact_complements():
    pattern = dict(packing.plan({600: 3, 424: 2, 200: 1, 224: 1, 300: 1}, 1024))
    assert pattern[(600, 424)] == 2 and pattern[(600, 224, 200)] == 1
    rnd = random.Random(2)
    for _ in range(60):
        counts = {rnd.randint(1, 64): rnd.randint(1, 40) for _ in range(rnd.randint(0, 30))}
        used = Counter()
        for lengths, k in packing.plan(counts, 64):
            assert sum(lengths) <= 64 and k > 0
            for n in lengths:
                used[n] += k
        assert used == Counter(counts)
    with pytest.raises(ValueError):
        packing.plan({65: 1}, 64)


def test_shards_are_the_smallest_possible(docs, empty, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCKS", 64)
    rows = sharding.shard(docs, shards=5).collect()
    assert len(rows) == docs.count()
    groups, sizes = {}, Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    for s in set(r["shard"] for r in rows):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    by_doc = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in rows}
    for r in docs.collect():
        groups.setdefault(r["text"], set()).add(by_doc[(r["doc_id"], zlib.crc32((r["text"] or "").encode()))])
    assert all(len(s) == 1 for s in groups.values())
    assert sharding.shard(empty).count() == 0
    # the smallest capacity, by trying every sum of neighbouring groups in the order of the shards
    ends, at, last = [], 0, None
    for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
        if last is not None and r["text_crc32"] != last:
            ends.append(at)
        at, last = at + r["size"], r["text_crc32"]
    ends.append(at)

    def needed(capacity):
        used, begin = 0, 0
        while begin < at:
            fits = [e for e in ends if begin < e <= begin + capacity]
            if not fits:
                return 99
            begin, used = max(fits), used + 1
        return used

    assert needed(max(sizes.values())) <= 5 < needed(max(sizes.values()) - 1)


@pytest.mark.parametrize("blocks", [16, 1 << 15])
def test_minimax_capacity_is_exact(spark, monkeypatch, blocks):
    monkeypatch.setattr(sharding, "BLOCKS", blocks)
    rnd = random.Random(blocks)
    for n, shards in ((1, 3), (40, 4), (400, 16)):
        ends, total = [], 0
        for _ in range(n):
            total += rnd.choice([1, 7, rnd.randint(1, 10**5)])
            ends.append(total)

        def fits(capacity, ends=ends, total=total, shards=shards):
            at = 0
            for _ in range(shards):
                at = max([e for e in ends if at < e <= at + capacity], default=at)
            return at == total

        low, high = 1, total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if fits(mid) else (mid + 1, high)
        cuts = sharding.minimax_cuts(spark.createDataFrame([(e,) for e in ends], "end long"), total, shards)
        assert max(b - a for a, b in zip([0, *cuts[:-1]], cuts, strict=True)) == low


def test_mix_meets_its_targets(docs, empty):
    rows = mixing.report(docs).collect()
    source = {(r["doc_id"], r["text"]): r["source"] for r in docs.collect()}
    assert len(rows) == docs.count() and len(source) > 50
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    by_size = {}
    for r in rows:
        by_size.setdefault((r["source_size"], r["target"]), []).append(r)
    total = sum(size for size, _ in by_size)
    assert abs(sum(t for _, t in by_size) - total) < 1e-6 * total
    for (size, target), own in by_size.items():
        assert target <= 3 * size + 1e-9
        assert abs(sum(r["taken"] for r in own) - target) <= 2 * max(r["size"] for r in own)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.report(docs.repartition(3)).collect()))
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns
    assert sum(len(words(r["text"])) for r in taken.collect()) == sum(r["taken"] for r in rows)
    assert mixing.report(empty).count() == 0


def test_license_scan(docs, empty, spark):
    mit = licenses.TEXTS["MIT"]
    texts = ["Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(", ", " , "), mit.replace("sublicense", "sub-licence"), mit + " more", "Some text.\nreleased under the MIT licence\nEnd.", None, ""]
    rows = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i]["license"] for i in range(6)] == ["MIT", "MIT", None, None, None, None]
    assert rows[3]["notices"] == "MIT" and rows[3]["n_notices"] == 1 and rows[5]["notices"] == ""
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0
    own = [(i, t) for i, t in enumerate([*ODD, *licenses.TEXTS.values(), "© x\nText—with “marks” and Ünïcode"])]
    got = spark.createDataFrame(own, "i int, text string").select("i", licenses.canonical(F.coalesce("text", F.lit(""))).alias("c")).collect()
    assert {r["i"]: r["c"] for r in got} == {i: licenses.canonical_text(t or "") for i, t in own}


def test_whole_license_texts(spark):
    """Every known text, wrapped, titled, with a notice and with other spellings, and inside other text."""
    import os
    import textwrap

    rows, want = [], {}

    def add(text, name):
        want[len(rows)] = name
        rows.append((len(rows), text))

    for name, text in licenses.TEXTS.items():
        for title in ("", *licenses.TITLES.get(name, ())):
            add("\n".join(textwrap.wrap(f"{title}\n\n{text}" if title else text, 60)), name)
            add(f"{title.upper()}\n\nCopyright (c) 1999-2024, The Authors <x@example.org>\nAll rights reserved.\n\n" + text.replace("license", "licence").replace("copyright notice", "\ncopyright notice"), name)
        add(text[:-30], None)
    folder = "/usr/share/common-licenses"
    shipped = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0"}
    for file, name in shipped.items():
        if os.path.exists(f"{folder}/{file}"):
            text = open(f"{folder}/{file}", encoding="utf-8").read()
            add(text, name)
            add(text.upper().replace("LICENSE", "LICENCE").replace("; ", " ;\t"), name)
            if not any(re.match(licenses.NOTICE_LINE, line) for line in text.lower().split("\n")):
                add(" ".join(text.split()), name)
            add(text[: len(text) // 2], None)
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["license"] for i, r in got.items()} == want
    inside = "Foreword.\n" + licenses.TEXTS["ISC"] + "\nThe end."
    own = licenses.scan(spark.createDataFrame([(1, inside), (2, "my own notice\nhere")], "doc_id long, text string"))
    assert {r["doc_id"]: (r["license"], r["notices"]) for r in own.collect()} == {1: (None, "ISC"), 2: (None, "")}
    import hashlib

    table = {hashlib.sha256(b"my own notice").hexdigest(): "X"}
    given = licenses.scan(spark.createDataFrame([(1, inside), (2, "My own  notice!\nhere")], "doc_id long, text string"), table=table)
    assert {r["doc_id"]: r["notices"] for r in given.collect()} == {1: "", 2: "X"}


def test_mix_takes_any_column_name(spark):
    rows = [(i, f"w{i} " * (i % 9), "ab"[i % 2], i, i, i) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, __size int, __0 int, __copies int")
    out = mixing.mixed_documents(table)
    assert out.columns == table.columns and all(r["__size"] == r["__0"] == r["__copies"] == r["doc_id"] for r in out.collect())


def test_token_file_with_null_and_repeated_ids(docs):
    rows = docs.select("doc_id", "text").collect()
    got = token_file.round_trip(docs).collect()
    size = {}
    for r, ids in zip(rows, library(tokens.BYTE_BPE, [r["text"] for r in rows]), strict=True):
        size.setdefault(str(r["doc_id"]), []).append((len(ids) + 1, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*ids, 0]))))
    have = {}
    for r in got:
        have.setdefault(str(r["doc_id"]), []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in size.items()}
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x))
