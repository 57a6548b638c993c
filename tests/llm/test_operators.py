"""Every operator against a plain version of its definition, on awkward rows, and on empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fundperf.llm import (
    decontamination,
    license_scan,
    packing,
    quality_classifier,
    quality_rules,
    queries,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
    url_filter,
)
from tests.llm.cases import clashing_docs, edge_docs, edge_rows, empty_docs, plain_rows, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_order(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


# 1 URL filter ---------------------------------------------------------------------------------------------


def url_rows():
    urls = [
        "http://Www.Example.NET/en/5?x=1",
        "https://example.net/en/",
        "http://freemoney.example.org/win/now77",
        "http://freemoney.example.net/de/win",
        "http://riverstone.example.org/fr/a",
        "http://riverstone.example.org/es/a",
        "http://example.com/de/7#x",
        "http://notexample.com/de/7",
        "http://shop.example.net",
        "no scheme here",
        "://",
        "",
        None,
        "ftp://a://b/c",
        "http://" + "ab" * 300 + ".org/q",
    ]
    html = "<p class='x'>free money river stone free money river stone win</p>"
    return [(i, url, html if i % 2 else None) for i, url in enumerate(urls)] + [(0, urls[0], html)]


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host, best = host.translate(LOWER), None
    for h, p, verdict in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (not best or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


def test_urls_follow_the_rules_and_then_the_model(spark):
    pages = spark.createDataFrame(url_rows(), "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = url_filter.filter_urls(pages.withColumn("token", F.lit(2)), url_filter.RULES).collect()
    assert len(got) == len(url_rows())
    by_id = {r["page_id"]: r for r in got}
    for page_id, url, _ in url_rows():
        host, path, rule, verdict = plain_url(url)
        row = by_id[page_id]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule), url
        assert row["verdict"] == (verdict or ("block" if row["score"] > 0 else "allow"))
    assert by_id[2]["host_words"] == "free money example org"
    assert by_id[5]["host_words"] == "river stone example org"


def test_url_scores_are_naive_bayes(spark):
    pages = spark.createDataFrame(url_rows(), "page_id long, url string, html string")
    got = url_filter.filter_urls(pages, url_filter.RULES).collect()
    counts, classes = {"block": Counter(), "allow": Counter()}, Counter()

    def tokens(row):
        lowered = re.sub("[0-9]+", "0", row["path"].lower())
        return row["host_words"].split() + re.findall(r"0|[^\x00-\x60\x7B-\x7F]+", lowered)

    for row in got:
        if row["rule"]:
            classes[row["verdict"]] += 1
            counts[row["verdict"]].update(tokens(row))
    vocabulary = set(counts["block"]) | set(counts["allow"])
    for row in got:
        score = np.log((classes["block"] + 1) / (classes["allow"] + 1))
        for token in tokens(row):
            if token in vocabulary:
                share = {c: (counts[c][token] + 1) / (counts[c].total() + len(vocabulary)) for c in counts}
                score += np.log(share["block"] / share["allow"])
        assert abs(row["score"] - score) < 1e-4


def test_best_split_is_the_most_likely():
    lexicon = {"now": 30, "here": 20, "nowhere": 10, "no": 50, "where": 25}
    total = sum(lexicon.values())
    run = "nowhere"
    known = {(i, j - i): lexicon[run[i:j]] for i in range(7) for j in range(i + 1, 8) if run[i:j] in lexicon}
    assert url_filter.best_split(run, known, total) in (["no", "where"], ["nowhere"])

    def likelihood(words):
        return sum(np.log(lexicon[w] / total) if w in lexicon else np.log(10.0 ** (1 - len(w)) / total) for w in words)

    def splits(text):
        if not text:
            return [[]]
        return [[text[:i], *rest] for i in range(1, len(text) + 1) for rest in splits(text[i:])]

    assert likelihood(url_filter.best_split(run, known, total)) == pytest.approx(max(map(likelihood, splits(run))))


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.filter_urls(pages, url_filter.RULES).count() == 0


# 2 decontamination ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def benchmark_rows():
    return [(i, prose(2000 + i, 15 + 4 * i)) for i in range(10)] + [(90, None), (91, ""), (92, "lonely")]


def test_leaks_and_paraphrases_are_found_and_clean_documents_are_not(spark, benchmark_rows):
    items = dict(benchmark_rows)
    rng, docs, leaks = random.Random(5), [], set()
    for d in range(120):
        words = prose(5000 + d, 40 + 3 * d).split()
        if d % 4 == 0:
            item = items[d % 10].split()
            if d % 8 == 0:  # paraphrased: every sixth word replaced
                item = [w if i % 6 else f"other{i}" for i, w in enumerate(item)]
            at = rng.randrange(len(words))
            words[at:at] = item
            leaks.add((d, d % 10))
        docs.append((d, " ".join(words).upper() if d % 12 == 0 else " ".join(words)))
    frame = spark.createDataFrame([*docs, (500, None), (501, ""), (None, items[3])], "doc_id long, text string")
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    got = decontamination.find_leaks(frame.withColumn("item_id", F.lit(7)), bench.withColumn("doc_id", F.lit(1)))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == leaks | {(None, 3)}


def test_long_documents_are_searched_to_the_end(spark, benchmark_rows):
    text = prose(1, 250_000) + " " + dict(benchmark_rows)[7] + " " + prose(2, 100)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    got = decontamination.find_leaks(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 7)]


def test_common_length_is_that_of_the_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice([1, 2, 3]) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_length(decontamination.word_masks(a), len(a), b) == table[-1][-1]


def test_small_blocks_find_the_same(spark, benchmark_rows, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 50) + " " + text) for i, (_, text) in enumerate(benchmark_rows[:10])], "doc_id long, text string")
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    columns = ("doc_id", "item_id", "share")
    whole = plain_rows(decontamination.find_leaks(docs, bench), *columns)
    monkeypatch.setattr(decontamination, "BLOCK", 5)
    assert plain_rows(decontamination.find_leaks(docs, bench), *columns) == whole
    assert {row[:2] for row in whole} >= {(i, i) for i in range(10)}


def test_short_and_much_edited_items_are_found_at_every_offset(spark):
    """Items that cosines miss: few words, or just SHARE of the words kept."""
    rng, bench, docs, leaks = random.Random(8), [], [], set()
    for n in [*range(2, 17), 20, 24, 31, 45]:
        item = prose(7000 + n, n).split()
        bench.append((n, " ".join(item)))
        need = decontamination.Item.of(n, " ".join(item).encode()).need
        for offset in range(8):
            # The last third stays; what is replaced lies before it.
            gone = set(rng.sample(range(n - max(3, -(-n // 3))), n - need)) if offset % 2 and n > need else ()
            copy = [f"other{i}" if i in gone else w for i, w in enumerate(item)]
            words = prose(8000 + 10 * n + offset, 160 + offset).split()
            words[80 + offset : 80 + offset] = copy
            docs.append((100 * n + offset, " ".join(words)))
            leaks.add((100 * n + offset, n))
    got = decontamination.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    )
    assert leaks <= {(r["doc_id"], r["item_id"]) for r in got.collect()}


def test_words_of_every_passage_count(spark):
    item = prose(70, 20)
    docs = spark.createDataFrame([(1, item), (2, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontamination.find_leaks(docs, bench).collect()
    assert [(r["share"], round(r["cosine"], 3)) for r in got] == [(1.0, 1.0)] * 2


def test_the_latent_space_is_fitted_on_all_passages(spark, monkeypatch):
    """The product that is factored is A'A Omega of every passage, whatever number of passages was once enough."""
    monkeypatch.setattr(decontamination, "FIT", 2, raising=False)
    monkeypatch.setattr(decontamination, "FIT_WORDS", 100, raising=False)
    texts = [prose(9000 + d, 30 + 17 * d).encode() for d in range(12)]
    rows = [(codes.tobytes(),) for codes in decontamination.numbers(texts)]
    products, summed = [], decontamination.summed

    def kept(*given):
        products.append(summed(*given))
        return products[-1]

    monkeypatch.setattr(decontamination, "summed", kept)
    docs = [(d, text.decode()) for d, text in enumerate(texts)]
    bench = spark.createDataFrame([(1, docs[0][1])], "item_id long, text string")
    decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    passages = [np.frombuffer(r[0], np.uint32)[a : a + 24] % decontamination.DIM for r in rows for a in range(0, len(r[0]) // 4, 24)]
    matrix = np.zeros((len(passages), decontamination.DIM))
    for row, own in zip(matrix, passages):
        np.add.at(row, own, 1)
    idf = np.log((len(passages) + 2) / ((matrix > 0).sum(axis=0) + 1))
    omega = np.zeros((decontamination.DIM, decontamination.RANK + decontamination.OVERSAMPLE))
    np.put_along_axis(omega, *decontamination.random_matrix(), axis=1)
    weighted = matrix * idf
    expected = weighted.T @ (weighted @ omega)
    assert np.abs(products[1] - expected).max() < 1e-4 * np.abs(expected).max()


def test_an_answer_is_asked_for_only_where_an_item_marks_one():
    words = [f"word{i}" for i in range(30)]
    marked = [*words[:20], "answer", *words[20:]]

    def shares(item, held):
        own = decontamination.Item.of(1, " ".join(item).encode())
        return own.found(decontamination.numbers([" ".join(held).encode()])[0].tolist())

    assert shares(words, words[:24]) == (0.8, 0.8)  # a leading excerpt counts like any other
    assert shares(words, words[6:]) == (0.8, 0.8)
    assert shares(words, words[:17]) is None
    assert shares(marked, marked[:25]) is None
    assert shares(marked, marked[:26]) == (26 / 31, 0.5)


def test_word_numbers_tell_words_apart_wherever_they_stand(monkeypatch):
    texts = [t.encode() for _, t, *_ in edge_rows() if t] + [b"", b" ", "ÉTÉ été Été".encode(), b"a" * 5000 + b" b"]
    for size in (1 << 20, 64):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        known = {}
        for text, codes in zip(texts, decontamination.numbers(texts)):
            words = decontamination.words_of(text)
            assert len(codes) == len(words)
            for word, code in zip(words, codes.tolist()):
                assert known.setdefault(word, code) == code
        assert len(set(known.values())) == len(known) > 500


def test_seeds_across_the_parts_of_a_long_document(spark, monkeypatch):
    item = prose(7, 30)
    text = prose(11, 990) + " " + item + " " + prose(12, 990)
    vectors, idf = np.zeros((decontamination.DIM, 1), np.float32), np.ones(decontamination.DIM)
    codes, at = decontamination.numbers([text.encode(), item.encode()])
    begin = next(i for i in range(len(codes)) if np.array_equal(codes[i : i + len(at)], at))
    for words in (begin, begin + 1, begin + 15, begin + 29, begin + 30, 100_000):
        monkeypatch.setattr(decontamination, "WORDS", words)
        found = decontamination.Searcher([(1, item.encode())], vectors, idf).search([codes, codes[:500], codes])
        assert [set(own) for own in found] == [{1}, set(), {1}]


def test_decontamination_of_empty_tables(spark, benchmark_rows):
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    assert decontamination.find_leaks(empty_docs(spark), bench).count() == 0
    assert decontamination.find_leaks(edge_docs(spark), bench.limit(0)).count() == 0


# 3 token counts -------------------------------------------------------------------------------------------


def test_token_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [r for r in edge_rows() if r[0] != 11]  # a word of 200,000 letters takes the library minutes
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), path)
    expected = [
        (d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows
    ]
    assert plain_rows(got, "doc_id", "n_bytes", "n_tokens") == in_order(expected)


def test_random_strings_count_alike():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), token_counts.TokenCounter(path)
    bits = ["'", "s", "t", "re", "ve", "ll", "r", "v", "l", "e", "m", "d", "É", "Σ", "İ", "½", "7", " ", "\n", "\u3000", "!", "<|endoftext|>", "中", "\U0001f642", "e\u0301", "'LL"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(1500)]
    assert counter.of(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_code_points_of_all_planes_count_alike():
    """Assigned or not, and in the blocks that newer Unicode versions have added letters to."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), token_counts.TokenCounter(path)
    blocks = [(0x80, 0x600), (0x1C80, 0x1CC0), (0x1E00, 0x2200), (0xA640, 0xA800), (0xAB30, 0xAC00), (0x10560, 0x105C0), (0x10D40, 0x10D90),
              (0x11380, 0x113F0), (0x13430, 0x13A00), (0x16100, 0x16140), (0x16D40, 0x16D80), (0x1CCF0, 0x1CD10), (0x1E5D0, 0x1E600)]
    codes = sorted({*range(1, 0x110000, 211), *(c for low, high in blocks for c in range(low, high))} - set(range(0xD800, 0xE000)))
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 'S{chr(c)}E\u0301" for c in codes]
    rng = random.Random(3)
    texts += ["".join(chr(rng.choice(codes)) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = counter.of(texts).tolist()
    assert [t for t, a, b in zip(texts, got, expected) if a != b] == []


def test_token_counts_of_empty_and_clashing_tables(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.count_tokens(empty_docs(spark), path).collect() == []
    columns = ("doc_id", "n_bytes", "n_tokens")
    clashing = clashing_docs(spark).withColumns({"n_tokens": F.lit("x"), "n_bytes": F.lit(None)})
    assert plain_rows(token_counts.count_tokens(clashing, path), *columns) == plain_rows(token_counts.count_tokens(edge_docs(spark), path), *columns)


def test_prefix_scan_gives_the_sequential_states():
    step, _ = token_counts.pretoken_tables()
    kinds = np.random.default_rng(0).integers(0, 10, (37, token_counts.CHUNK)).astype(np.uint8)
    state, expected = token_counts.GAP, []
    for row in kinds:
        expected.append(state)
        for kind in row:
            state = step[state, kind]
    assert token_counts.scan_states(kinds, step).tolist() == expected


def test_what_a_worker_remembers_of_pairs_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "PAIRS", 40, raising=False)
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    counter = token_counts.TokenCounter(vocabulary)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    texts = [prose(400 + i, 60) + f" antidisestablishmentarianism{i} naïveté" for i in range(20)]
    expected = [len(library.encode(text, add_special_tokens=False).ids) for text in texts]
    assert counter.of(texts).tolist() == expected
    assert len(counter.counts.transducer.merges.agree) <= 40


# 4 substring dedup ----------------------------------------------------------------------------------------


def plain_repeats(rows, length):
    first = {}
    for d, text in rows:
        words = SPLIT.findall(text or "")
        for s in range(len(words) - length + 1):
            key = tuple(words[s : s + length])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for d, text in rows:
        words = SPLIT.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            if d is not None and first[tuple(words[s : s + length])] < d:
                gone[s : s + length] = [True] * length
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return in_order(out)


def digest(df):
    return plain_rows(df, "others.doc_id", "n_words", "n_removed", "kept_sha256")


def test_repeats_in_awkward_rows(spark):
    rows = [(d, t) for d, t, *_ in edge_rows()]
    assert digest(substring_dedup.dedup_substrings(clashing_docs(spark))) == plain_repeats(rows, 50)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_on_random_mosaics(spark, seed):
    """Few words and many shared blocks: repeats nest, overlap, touch the ends and repeat in a document."""
    rng = random.Random(seed)
    blocks = [[rng.choice("abcde") + str(rng.randrange(4 + 30 * (seed % 2))) for _ in range(rng.randrange(5, 90))] for _ in range(12)]
    rows = [(rng.randrange(200), " ".join(w for b in rng.choices(blocks, k=rng.randrange(1, 7)) for w in b)) for _ in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(substring_dedup.dedup_substrings(docs)) == plain_repeats(rows, 50)
    assert digest(substring_dedup.dedup_substrings(docs, 20, 6)) == plain_repeats(rows, 20)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.dedup_substrings(empty_docs(spark)).count() == 0


# 5 licence scan -------------------------------------------------------------------------------------------


def test_license_places_are_those_of_a_plain_search(spark):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    texts = [(i, t) for i, t in enumerate(t for _, t, *_ in edge_rows())]
    notice = license_scan.NOTICES[1][1]
    texts += [(100, "Apache License MIT License apache-LICENSE"), (101, prose(1, 500) + " " + notice + "."), (102, "general public public license")]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(got) == len(texts)
    for d, text in texts:
        words = word.findall((text or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            parts = phrase.split()
            own = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
            places += own
            labels |= {label} if own else set()
        row = got[d]
        assert (row["n_words"], row["n_base"], row["base_labels"]) == (len(words), len(places), ",".join(sorted(labels)))
        assert (row["first_word"], row["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1
    assert got[101]["labels"] == "mit-notice" and got[101]["score"] == 1.0


def test_a_notice_with_small_edits_counts_and_scattered_words_do_not(spark):
    notice = license_scan.NOTICES[1][1]
    edited = notice.replace("software and", "work and").replace("deal in", "deal with")
    scattered = " ".join(sorted(notice.split()))
    rows = [(1, prose(3, 90) + " " + edited), (2, scattered), (3, notice.replace("hereby granted", "granted"))]
    rows += [(10 + i, prose(i, 80)) for i in range(30)]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "mit-notice" and got[2] == "" and got[3] == ""
    assert license_scan.scan_licenses(empty_docs(spark)).count() == 0


# 6 sharding -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_and_its_inverse(n):
    rows = np.arange(n)
    placed = sharding.permute(rows, n)
    assert sorted(placed.tolist()) == rows.tolist()
    assert sharding.permute(placed, n, backwards=True).tolist() == rows.tolist()
    shard, slot = sharding.locate(rows, n, 5)
    assert sharding.row_at(shard, slot, n, 5).tolist() == rows.tolist()


def test_shards_are_even_gapless_and_reproducible(spark):
    docs = clashing_docs(spark).unionAll(clashing_docs(spark))
    key = ["doc_id", "crc"]
    rows = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    got = plain_rows(sharding.shuffle_shards(rows, key, 7), "shard", "slot", *key)
    slots = defaultdict(list)
    for shard, slot, *_ in got:
        slots[shard].append(slot)
    sizes = [len(slots[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == rows.count()
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert plain_rows(sharding.shuffle_shards(rows.repartition(5), key, 7), "shard", "slot", *key) == got
    assert sharding.shuffle_shards(rows.limit(0), key).count() == 0


def test_columns_of_any_name_keep_their_values(spark):
    names = ["doc_id", "bucket", "digest", "first", "within", "row", "_bucket", "_digest", "_first", "_within", "a.b"]
    rows = [(i, *[f"{name}{i}" for name in names[1:]], i % 3, i % 2, "x") for i in range(30)]
    frame = spark.createDataFrame(rows, [*names, "shard", "slot", "row_number"])
    got = sharding.shuffle_shards(frame, ["doc_id", "shard"], 4)
    assert got.columns == [*names, "row_number", "shard", "slot"]
    assert sorted(tuple(r)[: len(names)] for r in got.collect()) == sorted(r[: len(names)] for r in rows)
    assert sorted(r["row_number"] for r in got.collect()) == list(range(30))


def test_the_registered_shards_hold_every_document_as_it_is(spark):
    import zlib

    sf_dir = "/root/testdata/sf0.001"
    got = queries.QUERIES["op6_sharding"](spark, sf_dir).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    slots = defaultdict(list)
    for r in got:
        text = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 8, zlib.crc32(text), "rows", None)
        shard, slot = sharding.locate(np.array([r["row_number"]]), len(texts))
        assert (r["shard"], r["slot"]) == (shard[0], slot[0])
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24)) and all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1



# 7 quality rules ------------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = SPLIT.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [line for line in text.split("\n") if SPLIT.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures_are_those_of_a_plain_count(spark):
    rows = [(d, t) for d, t, *_ in edge_rows()]
    got = quality_rules.judge(clashing_docs(spark).drop("kept"))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert plain_rows(got, *columns) == in_order((d, *plain_measures(t)) for d, t in rows)
    for row in got.collect():
        hard = row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"]
        assert row["base_failed"] == hard and not (hard and row["kept"])


def test_only_failing_documents_of_bad_hosts_go(spark):
    good = [(i, prose(i, 100), "good") for i in range(100)]
    bad = [(1000 + i, "# ".join(prose(i, 100).split()), "bad") for i in range(60)] + [(2000, prose(7777, 100), "bad")]
    one = [(3000, "# ".join(prose(4, 100).split()), "good")]
    docs = spark.createDataFrame(good + bad + one, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality_rules.judge(docs).filter("kept").collect()}
    assert kept == {d for d, *_ in good} | {2000, 3000}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_the_host_verdict_decides(spark, size, monkeypatch):
    """Hosts lie on both sides of the limit, and without the host part other documents stay."""
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    judged = quality_rules.judge(docs)
    failing = judged.filter("soft_failed AND NOT base_failed").groupBy("kept").count().collect()
    assert {r["kept"] for r in failing} == {True, False}
    assert judged.filter("bad").select("host").distinct().count() >= 1
    assert judged.filter("NOT bad").select("host").distinct().count() >= 1
    monkeypatch.setattr(quality_rules, "DEVIATIONS", -1e9)
    strict = quality_rules.judge(docs).filter("kept").count()
    monkeypatch.setattr(quality_rules, "DEVIATIONS", 1e9)
    lenient = quality_rules.judge(docs).filter("kept").count()
    assert strict < judged.filter("kept").count() < lenient


def test_it_takes_more_than_one_document_to_make_a_host_bad(spark):
    rows = [(f"h{i}", i * 37 % 100 < 18) for i in range(30) for _ in range(40)] + [("single", True)] + [("worst", i % 5 > 0) for i in range(50)]
    frame = spark.createDataFrame([(h, False, b) for h, b in rows], "source string, base_failed boolean, soft_failed boolean")
    got = {r["host"]: r for r in quality_rules.host_rates(frame).collect()}
    assert got["worst"]["bad"] and not got["h1"]["bad"]


def test_host_rates_shrink_towards_the_mean(spark):
    rows = [("a", i < 50) for i in range(100)] + [("b", False)] * 100 + [("c", True)]
    frame = spark.createDataFrame([(h, b, False) for h, b in rows], "source string, base_failed boolean, soft_failed boolean")
    rates = {r["host"]: r for r in quality_rules.host_rates(frame).collect()}
    mean = 51 / 201
    assert 0 < rates["b"]["rate"] < mean < rates["a"]["rate"] < 0.5
    assert mean < rates["c"]["rate"] < 1.0
    assert quality_rules.judge(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_against_sql(spark, name):
    from tests.compare import connect, first_difference, oracle_rows, spark_rows

    sf_dir = "/root/testdata/sf0.001"
    got = spark_rows(queries.QUERIES[name](spark, sf_dir))
    expected = oracle_rows(connect(sf_dir), queries.ORACLES[name])
    assert got[0] == expected[0] and first_difference(got[1], expected[1]) is None


# 8 quality classifier -------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    scores = quality_classifier.op8_quality_classifier(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    unseen = scores.filter("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in unseen) / len(unseen) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scores.collect())


def test_interactions_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_classifier.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_classifier_bears_awkward_rows_and_no_labels(spark):
    docs = clashing_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_classifier.score_quality(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (6, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    scored = quality_classifier.score_quality(docs, labels).collect()
    assert len(scored) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality_classifier.score_quality(empty_docs(spark), labels).count() == 0


# 9 packing ------------------------------------------------------------------------------------------------


def test_every_id_lies_in_one_piece(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = edge_rows()
    rows = [r for r in rows if r[0] not in (4, 13, None)]  # ids that tell rows apart
    got = packing.pack_public(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for d, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[d], key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces)])[:-1].tolist()
        assert sum(p["length"] for p in pieces) == len(ids) == pieces[0]["doc_tokens"]
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces)
    check_sequences(got)


def check_sequences(rows):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()
        assert sum(n for _, n in own) <= packing.SEQUENCE
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing_awkward_rows_and_nothing(spark):
    docs = clashing_docs(spark).unionAll(clashing_docs(spark))
    got = packing.pack_public(docs).collect()
    check_sequences(got)
    assert sum(r["start"] == 0 for r in got) == docs.count()
    assert packing.pack_public(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_the_demand_with_little_room(seed):
    rng = np.random.default_rng(seed)
    demand = np.zeros(65, np.int64)
    demand[rng.integers(1, 65, 30)] = rng.integers(1, 400, 30)
    plan = packing.cutting_plan(demand, 64)
    held = Counter()
    for times, pattern in plan:
        assert times > 0 and sum(s * c for s, c in pattern.items()) <= 64
        for s, c in pattern.items():
            held[s] += times * c
    assert dict(held) == {int(s): int(demand[s]) for s in np.flatnonzero(demand)}
    sizes = np.flatnonzero(demand)
    used, first_fit = sum(times for times, _ in plan), []
    for s in sizes[::-1]:
        for _ in range(demand[s]):
            at = next((i for i, room in enumerate(first_fit) if room >= s), None)
            if at is None:
                first_fit.append(64 - s)
            else:
                first_fit[at] -= s
    assert used <= len(first_fit) + len(sizes)


# 10 simhash -----------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = SPLIT.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_of_awkward_rows(spark):
    got = simhash.near_duplicate_groups(clashing_docs(spark)).collect()
    rows = edge_rows()
    assert in_order((r["doc_id"], r["fp"] % (1 << 64)) for r in got) == in_order((d, plain_fingerprint(t)) for d, t, *_ in rows)
    by_root = defaultdict(set)
    for r in got:
        by_root[r["root"]].add(r["component_id"])
    assert all(len(ids) == 1 for ids in by_root.values())
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 4)} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6, 7)} == {5}
    assert simhash.near_duplicate_groups(empty_docs(spark)).count() == 0


def test_links_are_exact(spark):
    """Clusters of all densities: components equal those of all pairs."""
    rng = np.random.default_rng(4)
    codes = list(rng.integers(0, 1 << 63, 400))
    for flips, size in ((1, 150), (2, 300), (3, 60), (5, 60), (6, 200)):
        center = int(rng.integers(0, 1 << 63))
        for _ in range(size):
            codes.append(center ^ sum({1 << int(b) for b in rng.integers(0, 64, flips)}))
    codes = np.unique(np.array([int(c) for c in codes], np.uint64))
    rng.shuffle(codes)
    n, a, b = len(codes), [], []
    for i in range(n):
        near = np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= 4) + i + 1
        a.append(np.full(len(near), i))
        b.append(near)
    expected = simhash.forest(n, np.concatenate(a), np.concatenate(b))
    signed = codes.view(np.int64)
    frame = spark.createDataFrame([(int(c),) for c in signed], "fp long")
    for blocks in (6, 7):
        edges = simhash.fingerprint_links(frame, 4, blocks).collect()
        place = {int(c): i for i, c in enumerate(signed)}
        u, v = (np.array([place[e[c]] for e in edges], np.int64) for c in ("u", "v"))
        assert (np.bitwise_count(codes[u] ^ codes[v]) <= 64).all()
        assert simhash.forest(n, u, v).tolist() == expected.tolist()


def test_one_large_group_is_linked_without_all_pairs():
    rng = np.random.default_rng(1)
    center = np.uint64(int(rng.integers(0, 1 << 63)))
    flips = np.array([sum({1 << int(b) for b in rng.integers(0, 64, 3)}) for _ in range(4000)], np.uint64)
    codes = np.unique(center ^ flips)
    order = np.argsort(codes)
    label = simhash.link_group(codes[order], 4)
    pairs = [np.flatnonzero(np.bitwise_count(codes[order][i + 1 :] ^ codes[order][i]) <= 4) + i + 1 for i in range(len(codes))]
    expected = simhash.forest(len(codes), np.repeat(np.arange(len(codes)), [len(p) for p in pairs]), np.concatenate(pairs))
    assert label.tolist() == expected.tolist()
