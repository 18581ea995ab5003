import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglake.llm import decontamination, langid, license_scan, packing, quality, queries, secret_scan, simhash, suffix_dedup, suffix_sort, token_counts, tokens, url_filter
from tests.llm import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, secrets int, fp string, path string"


def frame(spark, texts, first=0):
    rows = [(i + first, t, "en", "s", len(t or ""), "x", 1, "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(n, seed=0, alphabet="abcdefgh"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(n)]


# 1 secrets
def test_secrets_match_plain(spark):
    texts = plain.ODD_TEXTS + [
        'token = "abcdefgh1234"', "token=secret:abcdefgh1234", "PassWord:   'aaaaaaaa'", "api_key:short", "apikey=abcdefgh==", "AKIAABCDEFGHIJKL", "xxAKIAABCDEFGHIJKLM AKIA", "é" * 5 + "0" * 31 + " " + "f" * 32 + "g" + "0a" * 20,
        "a token: 12345678 token: 12345678", "tokenſ=12345678", "passwd='\"x", "AKIAAKIAAKIAAKIA" * 2,
    ]
    got = {r["doc_id"]: r["secrets"] for r in secret_scan.scanned(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [tuple(x) for x in got[i] if x["k"] < 3] == plain.secrets(t), t


def entropy(s):
    return max(-sum(c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values()) for i in range(len(s) - 19))


def test_entropy_spans(spark):
    r = random.Random(1)
    key = "".join(r.choice(secret_scan.ALPHABET[:62]) for _ in range(40))
    texts = [f"see {key} here", "see 123e4567-e89b-12d3-a456-426614174000 here", "theveryverylongwordofletters9", "ABCDEF0123456789" * 2, "/usr/local/lib/python3/dist-packages", f"token={key}", "aaaaaaaaaaaaaaaaaaaaaaaa1"]
    got = [r["secrets"] for r in secret_scan.scanned(frame(spark, texts)).orderBy("doc_id").collect()]
    assert [[x["k"] for x in g] for g in got] == [[3], [], [], [], [], [0], []]
    assert texts[0][got[0][0]["s"] : got[0][0]["e"]] == key and entropy(key) >= secret_scan.BITS["base64"]
    weight = spark.createDataFrame([(key,)], "m string").select(secret_scan._least_weight(F.col("m"))).first()[0]
    assert abs(math.log2(20) - weight / 20 / secret_scan.UNIT - entropy(key)) < 1e-5


def test_secret_query_equals_its_sql(spark, tmp_path):
    import duckdb

    r = random.Random(14)
    pieces = ['token = "', "Secret:", "api_key=", "passwd  :  '", "AKIA", "0123456789abcdef", "deadBEEF99", "é😀", " ", "\n", "-", "/", "=", "x7Qp", "example", "Zq9kL2mN8vB4xC6wT1yR"]
    texts = plain.ODD_TEXTS + ["".join(r.choices(pieces, k=r.randint(0, 25))) for _ in range(400)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op1_secret_scan(spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.execute(queries.oracle_sql()["op1_secret_scan"]).fetchall()) == got and any("entropy" in x[-1] for x in got)


def test_secrets_in_very_long_runs(spark):
    texts = ["a1//" * 30_000 + "z" * 40 + "9", "ab-" * 50_000 + "Q7" * 30, "0" * 100_000, "token=" * 20_000]
    got = {r["doc_id"]: r["secrets"] for r in secret_scan.scanned(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [tuple(x) for x in got[i] if x["k"] < 3] == plain.secrets(t)


@pytest.mark.parametrize("parts", [70, 700, 70_000])
def test_entropy_of_long_slugs(spark, tmp_path, parts):
    r = random.Random(19)
    key = "".join(r.choice(secret_scan.ALPHABET[:62]) for _ in range(40))
    texts = ["ab-" * parts + "end", "ab-" * parts + key, "/srv/data4" * (parts // 10) + "/" + key, key + "/ab" * parts, "token" + "-" * parts + key, "x " + "ab-" * parts + key + " y"]
    got = [[x["k"] for x in r["secrets"]] for r in secret_scan.scanned(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [[], [3], [3], [3], [3], [3]]
    if parts < 70_000:  # DuckDB cuts each window out of the whole run
        import duckdb

        frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(c.execute(queries.oracle_sql()["op1_secret_scan"]).fetchall()) == sorted(map(tuple, queries.op1_secret_scan(spark, str(tmp_path)).collect()))


def test_redaction_keeps_rows_and_columns(spark):
    docs = frame(spark, [None, "", "token = 'abcdefgh12345678' and " + "0a" * 20 + "!", "clean é text"])
    out = secret_scan.redacted(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {0: (None, 0), 1: ("", 0), 2: ("[SECRET]' and [SECRET]!", 23), 3: ("clean é text", 12)}


# 2 language
def test_language_backoff(spark):
    r = random.Random(2)
    own = {"aa": words(60, 1, "abcde"), "zz": words(60, 2, "uvxyz")}
    rows = [(i, " ".join(r.choices(own[lang], k=30)), lang) for i in range(300) for lang in [r.choice(["aa", "zz"])]]
    rows += [(1000, "abcdabcdabcd", None), (1001, "zyxzyxzyx", None), (1002, None, "aa"), (1003, "12 !!", "zz"), (None, "abcde", "aa")]
    got = {x["doc_id"]: x for x in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:300])
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["aa", "zz", "und", "und"]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i]["score"] <= 1 for i, _, _ in rows[:300])


def test_language_letters():
    assert [langid.words_of(t) for t in ("½²", "Ⅷ ①", "x²y ½", "É½é 3a", "m²", "Ab1c_d")] == [[], [], ["x", "y"], ["é", "é", "a"], ["m"], ["ab", "c", "d"]]


def test_language_scores_match_a_plain_version(spark):
    r = random.Random(20)
    own = {"aa": words(90, 3, "abcde"), "zz": words(90, 4, "bcdxyz")}
    rows = [(i, " ".join(r.choices(own[lang], k=r.randint(1, 30))) + r.choice(["", " Éé½", " 12"]), lang) for i in range(250) for lang in [r.choice(["aa", "zz"])]]
    rows += [(900 + i, t, None) for i, t in enumerate([" ".join(words(5, i)) for i in range(40)] + ["½²", "Ⅷ", "", "qqq", "日本"])]
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    train = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 5]
    for i, t, _ in rows:
        want = plain.language(t, train)
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-9, t


def test_language_stage_rejects_unlearned_languages(spark):
    r = random.Random(21)
    own = {"aa": words(60, 1, "abcde"), "zz": words(60, 2, "uvxyz")}
    rows = [(i, " ".join(r.choices(own[lang], k=30)), lang) for i in range(200) for lang in [r.choice(["aa", "zz"])]]
    rows += [(500 + i, " ".join(words(40, 100 + i, "abcdexyzfghijk")), "qq") for i in range(3)] + [(600, "abcd xyzzy", None), (601, "12 !", None)]
    kept = {x["doc_id"] for x in langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("lang != 'qq' or lang is null or doc_id % 2 > 5").unionByName(spark.createDataFrame([(i, t, None) for i, t, lang in rows if lang == "qq"], "doc_id long, text string, lang string"))).collect()}
    assert kept == {i for i, _, lang in rows if lang in own} | {600}


def test_language_learns_nothing_from_held_out_rows(spark):
    docs = spark.createDataFrame([(i, "abc def", "xx") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.language_id(docs).collect()} == {"und"}


# 3 licenses
def test_licenses_verify_exactly(spark):
    texts = plain.ODD_TEXTS + ["Hello. Released under the MIT License. " * 2, "released, under THE mit licence", " ".join(words(90)) + " " + license_scan.TEMPLATES["ISC"] + " end"]
    got = license_scan.license_matches(frame(spark, texts)).collect()
    n = len(plain.ODD_TEXTS)
    assert sorted((r["doc_id"], r["license"], r["containment"], r["first_word"]) for r in got) == [(n, "MIT-notice", 1.0, 1), (n, "MIT-notice", 1.0, 7), (n + 2, "ISC", 1.0, 90)]
    assert license_scan.license_matches(frame(spark, texts), {}).count() == 0


def test_license_bands_miss_no_close_copy():
    own, r = license_scan.Templates(license_scan.TEMPLATES), random.Random(3)
    for name, text in license_scan.TEMPLATES.items():
        for k in range(10):
            copy = text.split()
            if len(copy) > 60:
                copy[r.randrange(len(copy))] = "changed"
            found = own.matches(" ".join([*words(k * 7, k), *copy, *words(20, k)]))
            sought, whole = set(license_scan.shingles(license_scan.words_of(text)).tolist()), set(license_scan.shingles(license_scan.words_of(" ".join(copy))).tolist())
            assert len(sought & whole) / len(sought) < license_scan.CONTAINMENT or name in {m[0] for m in found}


def test_licenses_near_each_other_are_all_found():
    own = license_scan.Templates(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        copy = license_scan.words_of(text)
        n, excerpt = len(copy), copy[: len(copy) * 6 // 10]
        for gap in range(0, 201, 3 if n > 20 else 20):
            between = [w.encode() for w in words(gap, gap)]
            found = [m[1:] for m in own.matches(b" ".join([*copy, *between, *copy]).decode()) if m[0] == name]
            assert found == [(1.0, 0, n), (1.0, n + gap, n)], (name, gap)
            if n > 20:
                found = [m for m in own.matches(b" ".join([*excerpt, *between, *copy]).decode()) if m[0] == name]
                assert len(found) == 1 and found[0][1] == 1.0, (name, gap)
                assert found[0][2] + found[0][3] == len(excerpt) + gap + n or found[0][2] < len(excerpt), (name, gap)


# 4 and 6 tokens
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer_path())


def test_encoder_equals_library(library):
    own, r = tokens.ChunkEncoder(tokens.default_tokenizer_path()), random.Random(4)
    pool = [chr(i) for i in range(256)] + list("İΣςſé̌ẞß½中\u2028\u3000\u00ad") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'ll", "I'm"]
    texts = plain.ODD_TEXTS + ["".join(r.choices(pool, k=r.randint(0, 15))) for _ in range(3000)] + [f"A{c}b {c}{c}" for c in pool]
    for t in texts:
        assert list(memoryview(own.packed(t)).cast("I")) == library.encode(t or "", add_special_tokens=False).ids, t


def test_encoder_memo_is_bounded(monkeypatch, library):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 20)
    own = tokens.ChunkEncoder(tokens.default_tokenizer_path())
    for k in range(30):
        t = " ".join(words(15, k % 7) + words(3, k))
        assert list(memoryview(own.packed(t)).cast("I")) == library.encode(t, add_special_tokens=False).ids
        assert all(len(m) <= 60 for pair in own.memos.values() for m in pair)


def test_token_counts_and_store(spark, library, tmp_path):
    texts = plain.ODD_TEXTS + ["Word word WORD", "word word word", "É é", "<|endoftext|>", "<|ENDOFTEXT|>", "same", "same", " word\n\tWord  word "]
    docs, store = frame(spark, texts), f"file://{tmp_path}/store"
    for extra in (docs, docs.unionByName(frame(spark, ["new"], 100)), docs.limit(0)):
        got = {r["doc_id"]: r for r in token_counts.token_counts(extra, store, limit=2).collect()}
        for i, t in enumerate(texts if got else []):
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 2)
    kept = spark.read.parquet(store)
    assert kept.count() == kept.select("content").distinct().count()
    digests = {r["doc_id"]: r["d"] for r in docs.select("doc_id", token_counts.normalised(F.coalesce("text", F.lit(""))).alias("d")).collect()}
    n = len(plain.ODD_TEXTS)
    assert digests[n] == digests[n + 1] == digests[n + 7] == "word word word" and digests[n + 2] == "é é" and digests[n + 3] != digests[n + 4]


def test_normalising_changes_no_count(spark, library):
    r = random.Random(22)
    pool = [chr(i) for i in range(256)] + ["  ", "\n\n", " \t", "İ", "Σ", "é", "E\u0301", "中", "\u3000", "'S", "I'M", "<|", "<|endoftext|>"]
    texts = ["".join(r.choices(pool, k=r.randint(0, 20))) for _ in range(2000)] + [f"A{c} {c}B" for c in pool]
    got = {x["doc_id"]: x["d"] for x in frame(spark, texts).select("doc_id", token_counts.normalised(F.col("text")).alias("d")).collect()}
    for i, t in enumerate(texts):
        assert len(library.encode(t, add_special_tokens=False).ids) == len(library.encode(got[i], add_special_tokens=False).ids), t


def test_queries_find_counts_in_a_warm_store(spark, library, tmp_path, monkeypatch):
    docs = frame(spark, ["some words", "Some  Words", "other"])
    token_counts.token_counts(docs, f"file://{tmp_path}/store").count()
    before = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/store").collect()))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "own_path", lambda spark, name: f"file://{tmp_path}/store")
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op4_token_counts(spark, str(tmp_path)).collect()}
    assert got == {i: len(library.encode(t).ids) for i, t in enumerate(["some words", "some words", "other"])}
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/store").collect())) == before and len(before) == 2


def test_packing(spark, library):
    r = random.Random(5)
    texts = plain.ODD_TEXTS + [" ".join(words(r.randint(1, 900), k)) for k in range(60)] + ["dup dup"] * 3
    docs = frame(spark, texts).unionByName(frame(spark, [None], 3))
    got = packing.packed_documents(docs).orderBy("doc_id", "piece").collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    for x in got:
        part = ids[x["doc_id"]][x["start"] : x["start"] + x["length"]] if x["doc_id"] != 3 else [0]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == x["ids_crc32"] and x["start"] == 2048 * x["piece"]
    by_seq = {}
    for x in got:
        by_seq.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = np.array([x["length"] for x in got])
    assert lengths.sum() == sum(map(len, ids.values())) + 1
    assert packing.lower_bound(lengths) <= len(by_seq) <= packing.lower_bound(lengths) + 1


def test_packing_bound_and_exchange(spark):
    r = np.random.default_rng(6)
    for _ in range(30):
        lengths = r.integers(1, 11, int(r.integers(1, 9)))
        best = min(_bins(tuple(sorted(lengths, reverse=True)), 10))
        used = packing.best_fit_decreasing(lengths, 10)[2]
        assert packing.lower_bound(lengths, 10) <= best <= len(used) and used.sum() == lengths.sum() and used.max() <= 10
    cut = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(r.integers(300, 1200, 200))], packing.PIECES)
    one, many = packing.packed(cut, part_rows=1000), packing.packed(cut, part_rows=20)
    bins = [df.select("sequence_id").distinct().count() for df in (one, many)]
    assert many.count() == 200 and bins[0] <= bins[1] <= bins[0] * 1.1


def test_packing_exchanges_until_nothing_is_saved(spark):
    r = np.random.default_rng(23)
    cut = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(r.integers(300, 1200, 600))], packing.PIECES)
    got = packing.packed(cut, part_rows=10).collect()
    room, spans = Counter(), {}
    for x in got:
        room[x["sequence_id"]] += x["length"]
        spans.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    assert len(got) == 600 == len({x["doc_id"] for x in got}) and max(room.values()) <= 2048
    assert all(sum(n for _, n in own[:k]) == at for own in map(sorted, spans.values()) for k, (at, _) in enumerate(own))
    alone = packing.packed(cut, part_rows=1000).select("sequence_id").distinct().count()
    assert alone <= len(room) <= 1.2 * alone  # partitions of ten pieces meet their bounds early
    again = packing.packed(spark.createDataFrame([tuple(x)[:5] for x in got if x["gap"] and x["used"] < 2048] or [(0, 0, 0, 1, 0)], packing.PIECES), part_rows=10)
    assert again.select("sequence_id").distinct().count() >= len({x["sequence_id"] for x in got if x["gap"] and x["used"] < 2048}) - 1


def _bins(lengths, size, room=()):
    """Numbers of sequences of all packings worth a try."""
    if not lengths:
        yield len(room)
        return
    for i, x in enumerate(room):
        if x >= lengths[0]:
            yield from _bins(lengths[1:], size, room[:i] + (x - lengths[0],) + room[i + 1 :])
    yield from _bins(lengths[1:], size, (*room, size - lengths[0]))


# 5 simhash
def test_fingerprints_and_components(spark):
    texts = [t for t in plain.ODD_TEXTS] + [" ".join(words(80, 1)), " ".join(words(80, 1)[:-1] + ["x"]), " ".join(words(300, 2)), " ".join(words(300, 2) + ["tail"]), "A B", "a b"]
    got = {r["doc_id"]: r for r in simhash.simhash_components(frame(spark, texts)).collect()}
    fps = {i: plain.fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == plain.components(fps)


@pytest.mark.parametrize("bucket", [1500, 3])
def test_covering_masks_lose_no_link(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r, fps = random.Random(bucket), []
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(12):
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
            fps.append(x)
    fps = dict(enumerate(dict.fromkeys(fps)))
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps.values()], "fp long")
    root = {r["a"] % (1 << 64): r["root"] for r in simhash.roots(simhash.links(df)).collect()}
    want, groups, mine = plain.components(fps), {}, {}
    for i, x in fps.items():
        groups.setdefault(want[i], set()).add(x)
        mine.setdefault(root.get(x, simhash._signed(x)), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_masks_cover():
    for level, bits in enumerate([(1 << 64) - 1, 0xFFFF0000FFFF]):
        own, r, at = simhash.masks(bits, level), random.Random(level), [i for i in range(64) if bits >> i & 1]
        assert all(any(not sum(1 << i for i in pick) & m for m in own) for pick in (r.sample(at, 3) for _ in range(2000)))


def test_representatives(spark):
    docs = frame(spark, ["same text here now", "same text here now", "other words stand there"], 5)
    assert sorted(r["doc_id"] for r in simhash.keep_representatives(docs).collect()) == [5, 7]
    assert simhash.keep_representatives(docs.limit(0)).count() == 0


# 7 urls
def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame(
        [(1, "HTTP://A.Example.ORG/es/5?x#y"), (2, "http://example.org/en/12"), (3, "http://example.org/en/2"), (4, "http://x.com/fr/"), (5, "http://notcom/de/1"), (6, "a://com/de/1"), (7, None), (8, "nothing"), (9, "x://h"), (10, "x://?q://z/w"), (11, "http://myexample.org/es/1"), (12, "a:/b://C/d#e")],
        "page_id long, url string",
    )
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.url_verdicts(pages, spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert got == {
        1: ("a.example.org", "/es/5", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("example.org", "/en/2", "org/", "allow"), 4: ("x.com", "/fr/", "com/fr/", "allow"), 5: ("notcom", "/de/1", None, "allow"), 6: ("com", "/de/1", "com/de/", "block"),
        7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("h", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("myexample.org", "/es/1", "org/", "allow"), 12: ("c", "/d", None, "allow"),
    }


def test_mined_rules(spark):
    bad = [(i, f"http://ads{i % 9}.net/promo/buy/{i}", 1) for i in range(60)]
    good = [(100 + i, f"http://site{i % 9}.net/promo/{i}", 0) for i in range(60)] + [(200 + i, f"http://w.net/buy/{i}", 0) for i in range(60)]
    pages = spark.createDataFrame([x[:2] for x in bad + good] + [(500, "http://new.net/promo/buy/9"), (501, "http://new.net/promo/9"), (502, None)], "page_id long, url string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in bad + good] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(pages, labels).collect()}
    assert all(got[i] == "block" for i, _, _ in bad) and all(got[i] == "allow" for i, _, _ in good)
    assert (got[500], got[501], got[502]) == ("block", "allow", "allow")
    rules = url_filter.mined(pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", F.when(F.col("toxic") == 1, "block").otherwise("allow").alias("verdict")))
    kept = {(tuple(r["items"]), r["verdict"]): r["confidence"] for r in rules.collect()}
    assert (("path=buy", "path=promo"), "block") in kept
    assert not any(set(a) < set(b) and v == w and c >= d for (a, v), c in kept.items() for (b, w), d in kept.items())


def test_mined_rules_of_four_tokens(spark):
    parts = ["buy", "cheap", "now", "promo"]
    rows = [(i, "http://w.net/" + "/".join(parts), "block") for i in range(60)]
    rows += [(100 * k + i + 100, "http://w.net/" + "/".join(p for p in parts if p != gone), "allow") for k, gone in enumerate(parts) for i in range(60)]
    pages = spark.createDataFrame([x[:2] for x in rows] + [(900, "http://new.net/now/buy/promo/cheap/x")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(v == "block")) for i, _, v in rows], "doc_id long, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(pages, labels).collect()}
    assert got == {i: v for i, _, v in rows} | {900: "block"}
    kept = {(tuple(r["items"]), r["verdict"]): r["confidence"] for r in url_filter.mined(spark.createDataFrame([x[1:] for x in rows], "url string, verdict string")).collect()}
    assert [a for a, v in kept if v == "block"] == [tuple(f"path={p}" for p in parts)]
    assert not any(set(a) < set(b) and v == w and c >= d for (a, v), c in kept.items() for (b, w), d in kept.items())


def test_mined_rules_of_both_verdicts_compete(spark):
    rows = [(i, f"http://safe.net/promo/{i}", 0) for i in range(200)] + [(300 + i, f"http://x{i % 7}.net/promo/{i}", int(i % 4 > 0)) for i in range(100)]
    rows += [(600 + i, f"http://y{i % 7}.org2/plain/{i}", int(i % 2)) for i in range(200)]
    pages = spark.createDataFrame([x[:2] for x in rows] + [(900, "http://safe.net/promo/new"), (901, "http://x9.net/promo/new"), (902, "ftp://nothing/")], "page_id long, url string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(pages, labels).collect()}
    mine = spark.createDataFrame([(x[1], "block" if x[2] else "allow") for x in rows], "url string, verdict string")
    kept = {r["verdict"] for r in url_filter.mined(mine).collect()}
    assert "allow" in kept and (got[900], got[902]) == ("allow", "allow")


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_rules_match_a_plain_version(spark, seed):
    r = random.Random(seed)
    parts = ["buy", "now", "win", "faq", "doc"]
    rows = []
    for i in range(400):
        own = r.sample(parts, r.randint(1, 3))
        bad = ("buy" in own and "win" in own) or ("now" in own and r.random() < 0.7)
        rows.append((i, f"http://h{i % 3}.net/" + "/".join(own), int(bad != (r.random() < 0.05))))
    labelled = [(url, "block" if toxic else "allow") for _, url, toxic in rows]
    tokens_ = {x["url"]: x["t"] for x in spark.createDataFrame(labelled, "url string, verdict string").select("url", url_filter.tokens_of(F.col("url")).alias("t")).distinct().collect()}
    want = plain.url_rules([(tokens_[url], verdict) for url, verdict in labelled], max(url_filter.MIN_SUPPORT, url_filter.MIN_ROWS / len(rows)), url_filter.MIN_CONFIDENCE)
    rules = url_filter.mined(spark.createDataFrame(labelled, "url string, verdict string"))
    got = {(tuple(x["items"]), x["verdict"]): (x["confidence"], x["support"], x["evidence"]) for x in rules.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    pages = spark.createDataFrame([x[:2] for x in rows], "page_id long, url string")
    verdicts = {x["page_id"]: x["verdict"] for x in url_filter.url_verdicts(pages, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")).collect()}
    for i, url, _ in rows:
        fits = [(c[2], c[1], len(k[0]), k[1] == "block", k[1]) for k, c in want.items() if set(k[0]) <= set(tokens_[url])]
        top = max(fits)[:2] if fits else None
        assert verdicts[i] in ({x[-1] for x in fits if np.allclose(x[:2], top)} if fits else {"allow"})
    assert "block" in verdicts.values()


# 8 suffix array
def test_suffix_array_and_prefixes(monkeypatch):
    r = np.random.default_rng(7)
    for most in (8_000_000, 5):
        monkeypatch.setattr(suffix_sort, "IN_MEMORY", most)
        for k in range(120):
            s = np.tile(r.integers(0, 3, 4), 12) if k % 6 == 0 else r.integers(0, int(r.integers(1, 6)), int(r.integers(1, 70)))
            own = s.tolist()
            order, prefix = (x.tolist() for x in suffix_sort.suffix_array(s, most=7))
            assert order == sorted(range(len(own)), key=lambda i: own[i:]) == suffix_sort.suffix_array(s)[0].tolist()
            assert prefix == suffix_sort.common_prefix(s, np.array(order), 7).tolist() and prefix[0] == 0
            for a, b, n in zip(order, order[1:], prefix[1:], strict=False):
                assert n == next((i for i in range(7) if own[a + i : a + i + 1] != own[b + i : b + i + 1] or not own[b + i : b + i + 1]), 7)


def test_suffix_shards_that_spill(monkeypatch):
    r = random.Random(27)
    base = "".join(r.choices("abcde ", k=5000))
    rims = []
    for _ in range(150):
        i = r.randrange(4700)
        own = bytearray(base[i : i + r.randrange(200, 300)].encode())
        own[r.randrange(len(own))] = r.choice(b"ab#")
        rims.append(bytes(own))
    many = [r.random() < 0.1 for _ in rims]
    count = Counter(x[i : i + 200] for x, m in zip(rims, many, strict=True) for i in range(len(x) - 199) for _ in range(1 + m))
    want = [[count[x[i : i + 200]] > 1 for i in range(len(x) - 199)] for x in rims]
    spills = []
    spill = suffix_sort.BucketQueue._spill
    monkeypatch.setattr(suffix_sort.BucketQueue, "_spill", lambda self: (spills.append(self.held), spill(self)))
    for most in (8_000_000, 500):
        monkeypatch.setattr(suffix_sort, "IN_MEMORY", most)
        assert [x.tolist() for x in suffix_dedup.repeated_windows(rims, many)] == want
        assert bool(spills) == (most == 500)
    assert any(map(any, want)) and not all(map(all, want))


@pytest.mark.parametrize(("group", "chunk"), [(1000, 1 << 20), (2, 150)])
def test_suffix_dedup(spark, monkeypatch, group, chunk):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    r = random.Random(8)
    parts = ["".join(r.choice("abcd é\n") for _ in range(r.randint(150, 700))) for _ in range(8)]
    texts = plain.ODD_TEXTS + ["".join(r.choice(parts)[r.randint(0, 60) :] if r.random() < 0.6 else "".join(r.choices("xyz w", k=200)) for _ in range(r.randint(0, 4))) for _ in range(25)] + ["ab" * 400]
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.suffix_dedup(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain.suffix_removal(texts)


def test_suffix_contexts_in_chunks(monkeypatch):
    r = random.Random(9)
    raw = "".join(r.choices("abc ", k=3000)).encode() * 2
    whole = suffix_dedup.contexts(raw)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    parts = suffix_dedup.contexts(raw)
    assert {h for h in whole[0]} == {h for h in parts[0]} and parts[2][0] == 0 and parts[3][-1] == len(raw) - 200
    assert (parts[2][1:] == parts[3][:-1] + 1).all()


def test_suffix_halves_part_windows_by_their_core():
    r, length = random.Random(16), suffix_dedup.LENGTH
    base = "".join(r.choices("abcdefgh ", k=900))
    copies = ["".join(c if r.random() < 0.995 else "#" for c in base).encode() for _ in range(40)]
    rows = []
    for raw in copies:
        anchor, _, first, last = suffix_dedup.contexts(raw)
        rows += [(a, raw[i : j + length], -1, 0, length - suffix_dedup.GRAM) for a, i, j in zip(anchor.view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True)]
    at = lambda raw: [raw[i : i + length] for i in range(len(raw) - length + 1)]
    while any(low < high for *_, low, high in rows):
        keys, parts = {}, []
        for row in rows:
            for core, _, i, j, place, low, high in suffix_dedup.halves(*row):
                parts.append((core, row[1][i : j + length], place, low, high))
        assert Counter(w for row in rows for w in at(row[1])) == Counter(w for row in parts for w in at(row[1])) and len(parts) <= 2 * len(rows)
        for row in parts:
            for w in at(row[1]):
                assert keys.setdefault(w, row[0]) == row[0]
        rows = parts


def test_suffix_dedup_of_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 10)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 5000)
    r = random.Random(17)
    base = "".join(r.choices("abcdefgh \n", k=700))
    texts = ["".join(c if r.random() < 0.99 else "#" for c in base) for _ in range(90)] + [base] * 5
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.suffix_dedup(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain.suffix_removal(texts)


def test_suffix_repeated_rows(spark):
    text = " ".join(words(120))
    docs = frame(spark, [text, "short"]).unionByName(frame(spark, [text]))
    got = suffix_dedup.suffix_dedup(docs).where("doc_id = 0").collect()
    assert [(r["n_removed"], r["kept_sha256"]) for r in got] == [(len(text), hashlib.sha256(b"").hexdigest())] * 2


# 9 decontamination
def test_decontamination(spark):
    items = [(k, " ".join(words(30 + k, 50 + k)) + ". And " + " ".join(words(6, 90 + k)) + ".") for k in range(6)] + [(7, None), (8, ""), (9, "two words")]
    changed = items[2][1].split()
    for i in (3, 9, 15, 21):
        changed[i] = "other"
    texts = plain.ODD_TEXTS + [
        " ".join(words(100, 1)) + " " + items[0][1].upper() + " " + " ".join(words(70, 2)), " ".join(words(40, 3)) + " " + " ".join(changed), " ".join(words(400, 4)), items[1][1], " ".join(items[3][1].split()[:8]), "here are two words more",
    ]
    got = decontamination.leaks(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    n = len(plain.ODD_TEXTS)
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(n, 0), (n + 1, 2), (n + 3, 1), (n + 5, 9)]
    assert {r["doc_id"]: r["lcs"] for r in got}[n] == 1.0
    kept = decontamination.without_leaks(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(n), n + 2, n + 4]
    assert decontamination.leaks(frame(spark, texts), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_of_repeated_words(spark):
    item = "na na na na na na na batman hey jude"
    texts = ["they sang na na na na na na na batman hey jude all night", "na na na na na na na na other words hey jude follow", "not a word of it is here at all"]
    got = decontamination.leaks(frame(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"]: round(r["lcs"], 2) for r in got} == {0: 1.0, 1: 0.9}


def test_decontamination_loses_no_passage_of_a_large_benchmark(spark):
    r, pool = random.Random(15), words(3000, 15)
    own = [r.choices(pool, k=r.randint(8, 47)) for _ in range(2000)]
    items = [(k, " ".join(x[:-4]) + ". " + " ".join(x[-4:]) + ".") for k, x in enumerate(own)]
    texts = []
    for x in own:
        told = [w if i % 4 or i >= len(x) - 4 else "other" for i, w in enumerate(x)] if len(x) >= 16 and len(texts) % 2 else x
        texts.append(" ".join([*r.choices(pool, k=r.randint(0, 60)), *told, *r.choices(pool, k=r.randint(0, 60))]))
    got = decontamination.leaks(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {k for k, _ in items} - {r["doc_id"] for r in got if r["doc_id"] == r["item_id"]} == set()


def paraphrase(own, r, pool):
    """Three words in ten replaced, and two neighbouring stretches of four words swapped; the answer, the last six, stays."""
    body, answer = list(own[:-6]), list(own[-6:])
    for i in r.sample(range(len(body)), 3 * len(body) // 10):
        body[i] = r.choice(pool)
    i = r.randrange(0, max(1, len(body) - 8))
    return body[:i] + body[i + 4 : i + 8] + body[i : i + 4] + body[i + 8 :] + answer


def test_decontamination_recall_of_paraphrases(spark):
    r, pool = random.Random(24), words(4000, 24)
    own = [r.choices(pool, k=r.randint(30, 64)) for _ in range(400)]
    items = [(k, " ".join(x[:-6]) + ". " + " ".join(x[-6:]) + ".") for k, x in enumerate(own)]
    texts = [" ".join([*r.choices(pool, k=r.randint(0, 300)), *paraphrase(x, r, pool), *r.choices(pool, k=r.randint(0, 300))]) for x in own]
    texts += [" ".join(r.choices(pool, k=r.randint(50, 500))) for _ in range(200)]
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.leaks(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len({(k, k) for k in range(400)} & got) >= 0.9 * 400 and all(a == b for a, b in got)


def test_decontamination_matches_a_plain_version(spark):
    r, pool = random.Random(25), words(400, 25)
    own = [r.choices(pool, k=r.randint(5, 40)) for _ in range(30)]
    items = [(k, " ".join(x[:-3]) + ". " + " ".join(x[-3:]) + ".") for k, x in enumerate(own)]
    texts = []
    for k in range(60):
        x = own[k % 30]
        told = [w if r.random() > (k % 5) / 10 else r.choice(pool) for w in x]
        texts.append(" ".join([*r.choices(pool, k=r.randint(0, 60)), *told, *r.choices(pool, k=r.randint(0, 60))]))
    got = {(x["doc_id"], x["item_id"]): x["lcs"] for x in decontamination.leaks(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    sure, ruled_out = {}, set()
    for d, text in enumerate(texts):
        for k, item in items:
            share = plain.leak(text, item, decontamination.stretch_words)
            least = 1.0 if len(own[k]) < decontamination.SHORT else decontamination.SAME
            if share >= least:
                sure[d, k] = share
            elif len(own[k]) < decontamination.SHORT or share < decontamination.LIKE:
                ruled_out.add((d, k))
    missed = [p for p, share in sure.items() if p not in got]
    assert len(sure) >= 25 and not ruled_out & set(got)
    # Stretches start at every eighth of a passage, so a leak right at its limit may be seen a word short.
    assert all(sure[p] < decontamination.SAME + 2 / len(own[p[1]]) for p in missed) and len(missed) <= 1


def test_decontamination_in_chunks(monkeypatch):
    r, pool = random.Random(18), words(2000, 18)
    items = [(k, " ".join(r.choices(pool, k=r.randint(9, 64)))) for k in range(40)]
    block = decontamination.Block(items)
    block.idf = np.full(len(block.words) + 1, 1, dtype=np.float32)
    block.idf[0] = 0
    block.index_words()
    block.project(np.eye(len(block.words) + 1)[:, 1:200])
    text, want = [], set()
    for k in range(120):
        item = r.randrange(40)
        text += [*r.choices(pool, k=r.randint(0, 400)), *items[item][1].split()]
        want.add(item)
    text = " ".join(text)
    whole = decontamination.leaks_of(text, block)
    assert set(whole) == want and all(x[0] == 1.0 for x in whole.values())
    for most in (512, 1024):
        monkeypatch.setattr(decontamination, "CHUNK", most)
        monkeypatch.setattr(decontamination, "PIECE", 700)
        own = decontamination.words_of(text)
        chunks = list(decontamination.chunks_of(text))
        assert all(own[at : at + len(part)] == part for at, part in chunks) and chunks[-1][0] + len(chunks[-1][1]) == len(own)
        assert all(b[0] + decontamination.OVERLAP == a[0] + len(a[1]) for a, b in zip(chunks, chunks[1:], strict=False))
        assert {k: (x[0], x[3]) for k, x in decontamination.leaks_of(text, block).items()} == {k: (x[0], x[3]) for k, x in whole.items()}


def some_block(items, rank=200):
    block = decontamination.Block(items)
    block.idf = np.full(len(block.words) + 1, 1, dtype=np.float32)
    block.idf[0] = 0
    block.index_words()
    block.project(np.random.default_rng(3).standard_normal((len(block.words) + 1, rank)))
    return block


def test_decontamination_looks_at_short_texts_together(monkeypatch):
    r, pool = random.Random(31), words(300, 31)
    items = [(k, " ".join(r.choices(pool, k=r.randint(3, 64)))) for k in range(30)]
    texts = [*plain.ODD_TEXTS, None, "", "...", " ".join(r.choices(pool, k=6000))]
    for k in range(200):
        told = [w if r.random() > k % 4 / 10 else "other" for w in items[k % 30][1].split()]
        texts.append(" ".join([*r.choices(pool, k=r.randint(0, 40)), *told, *r.choices(pool, k=r.choice((0, 3, 200)))]))
    r.shuffle(texts)
    block = some_block(items)
    alone = [decontamination.leaks_of(text, block) for text in texts]
    calls, compared = [], []
    looked, common = decontamination.candidates, decontamination.lcs
    monkeypatch.setattr(decontamination, "candidates", lambda *x: calls.append(1) or looked(*x))
    monkeypatch.setattr(decontamination, "lcs", lambda *x: compared.append(1) or common(*x))
    assert decontamination.leaks_in(texts, block) == alone and sum(map(len, alone)) >= 100
    n = sum(len(decontamination.words_of(text)) for text in texts)
    assert len(calls) <= 2 + 2 * n // decontamination.CHUNK + len(texts) // decontamination.TOGETHER and len(compared) < 20 * len(texts)
    for most in (1, 7):
        monkeypatch.setattr(decontamination, "TOGETHER", most)
        assert decontamination.leaks_in(texts, block) == alone
    assert decontamination.leaks_in([], block) == []


def test_decontamination_windows_that_share_words():
    r, pool = random.Random(32), words(60, 32)
    block = some_block([(k, " ".join(r.choices(pool, k=r.randint(3, 64)))) for k in range(20)], 10)
    chunks = [r.choices([*pool, "unknown"], k=n) for n in (1, 15, 16, 17, 90, 300)] + [["unknown"] * 40]
    want, index, chunk, hop = set(), [], [], []
    for g, text in enumerate(chunks):
        own = block.index([w.encode() for w in text])
        for j, (at, weights) in enumerate(block.rare):
            weight = dict(zip(at.tolist(), weights.tolist(), strict=True))
            for i in range(0, len(text), 16):
                held = sum(weight.get(w, 0) for w in own[i : i + 16 * block.hops[j]].tolist())
                if held >= block.least[j] <= sum(weight.get(w, 0) for w in set(own.tolist())):
                    want.add((g, i // 16, j))
        there = np.flatnonzero(own)
        index += own[there].tolist()
        chunk += [g] * len(there)
        hop += (there // 16).tolist()
    index, chunk, hop = (np.array(x, dtype=np.int64) for x in (index, chunk, hop))
    possible = block.possible(index, chunk, len(chunks))
    got = list(block.sharing(index, chunk, hop, np.array([-(-len(x) // 16) for x in chunks]), possible))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_best_stretch_is_that_of_all_stretches():
    r = random.Random(33)
    for _ in range(300):
        a, b = ([bytes([r.randint(97, 104)]) for _ in range(r.randint(1, n))] for n in (30, 90))
        span, step = decontamination.stretch_words(len(a)), max(1, len(a) // 8)
        found = [(plain.lcs(a, b[i : i + span]), -i) for i in range(0, max(1, len(b) - span + step), step)]
        best, at = max(found)
        assert decontamination.best_stretch(a, b) == (best, -at)
        for least in range(len(a) + 1):
            assert decontamination.best_stretch(a, b, least) == ((best, -at) if best >= least else (0, 0))


def test_lcs():
    r = random.Random(10)
    for _ in range(200):
        a, b = ([bytes([r.randint(97, 100)]) for _ in range(r.randint(1, 20))] for _ in range(2))
        assert decontamination.lcs(a, b) == plain.lcs(a, b)


def test_randomised_basis_spans_the_leading_space(spark):
    r = np.random.default_rng(11)
    a = r.standard_normal((60, 5)) @ r.standard_normal((5, 40)) + 0.001 * r.standard_normal((60, 40))
    rows = spark.createDataFrame([(list(range(40)), x.tolist()) for x in a], "at array<int>, x array<double>").repartition(3)
    v = decontamination.randomised_basis(rows, 40, 5)
    exact = np.linalg.svd(a)[2][:5]
    assert np.allclose(np.linalg.svd(exact @ v)[1], 1, atol=1e-3)


# 10 quality
def test_rule_counts(spark):
    r = random.Random(12)
    texts = plain.ODD_TEXTS + ["a b c d e f g h " * 3, "x\ny\nx\n \n \nx ", "# * $ % & | < >"] + [" ".join(r.choices(["a", "b", "c\n", "\x1f", "é"], k=60)) for _ in range(20)]
    got = {x["doc_id"]: tuple(x)[1:] for x in quality.rule_statistics(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [plain.rule_counts(t) for t in texts]


def test_quality_verdicts(spark):
    texts = [" ".join(words(100 + k, k)) for k in range(300)] + [" ".join(["#$%&|<>*" * 9] * 40 + words(30, k)) for k in range(20)] + [None, "few words"]
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(320)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.quality_rules(frame(spark, texts), labels).collect()}
    assert all(got[i]["kept"] for i in range(300)) and not any(got[i]["kept"] for i in range(300, 322))
    assert [got[i]["base_failed"] for i in (0, 320, 321)] == [False, True, True]
    unlabelled = quality.quality_rules(frame(spark, texts), labels.limit(0)).collect()
    assert all(x["kept"] != x["base_failed"] for x in unlabelled)


def test_quality_threshold_ignores_rows_that_base_rules_reject(spark):
    good = [" ".join(words(100 + k, k)) for k in range(300)] + ["x" * 200 * 2**k + " y" for k in range(4)]
    bad = [" ".join(w + "#" * (i % 3 + k % 3) for i, w in enumerate(words(200 + k, 400 + k))) for k in range(6)]
    labels = spark.createDataFrame([(i, int(i < 304), 0) for i in range(310)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.quality_rules(frame(spark, good + bad), labels).collect()}
    assert all(got[i]["kept"] for i in range(300)) and all(got[i]["base_failed"] for i in range(300, 304))
    assert not any(got[i]["base_failed"] or got[i]["kept"] for i in range(304, 310))


def test_quality_threshold_matches_a_plain_version(spark):
    r = np.random.default_rng(26)
    score = np.round(r.beta(4, 5, 800), 4)
    label = (r.random(800) < np.where(score > 0.7, 0.1, 0.9)).astype(int)
    scores = spark.createDataFrame([(i, float(x)) for i, x in enumerate(score)] + [(900, 0.99), (None, 0.5)], "doc_id long, anomaly double")
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(label)] + [(901, 1), (900, None)], "doc_id long, quality int")
    for loss in (0.0, 0.01, 0.05, 0.3):
        got = quality.calibrated(scores, labels, loss)
        good, bad = score[label == 1], score[label == 0]
        want = next(k / 1000 for k in range(1001) if (good >= k / 1000).mean() <= loss)
        assert got == (want if (bad >= want).mean() > (good >= want).mean() else math.inf)


def test_forest_isolates():
    r = np.random.default_rng(13)
    rows = np.vstack([r.standard_normal((500, 5)), np.full((3, 5), 9.0)])
    score = quality.IsolationForest(rows).score(rows)
    assert score[500:].min() > np.quantile(score[:500], 0.99)


# all
def test_empty_tables(spark, tmp_path):
    docs, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench, pages = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "page_id long, url string, html string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench), ("pages", pages)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_null_ids_and_odd_texts(spark, tmp_path):
    docs = frame(spark, plain.ODD_TEXTS).unionByName(frame(spark, plain.ODD_TEXTS)).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, "x y z"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, "http://a.org/b"), (1, None), (1, None)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    n = 2 * len(plain.ODD_TEXTS)
    for name, query in queries.queries().items():
        got = query(spark, str(tmp_path)).count()
        assert got == (3 if name.startswith("op7") else 0 if name.split("_")[0] in ("op3", "op9") else got if name.startswith("op6") else n), name


def test_contract_columns(spark):
    assert re.fullmatch("[0-9a-f]{16}", queries.op5_simhash(spark, "/root/testdata/sf0.001").first()["fingerprint"])


@pytest.mark.parametrize("size", [1, 900, 1 << 30])
def test_shards_never_part_an_anchor(monkeypatch, size):
    """Whatever a shard holds, spans are those of each anchor's contexts by themselves."""
    import pyarrow as pa

    from siglake.llm import suffix_dedup

    r = random.Random(21)
    core = [bytes(r.choices(b"ab ", k=240)) for _ in range(6)]
    rows = [(a, d, d, 7 * d, False, core[a][: 210 + 10 * (d % 4)] + bytes(r.choices(b"xyz", k=5))) for a in range(6) for d in range(a)]
    names = ["anchor", "doc_id", "text_hash", "first", "many", "raw"]
    batches = [pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows[i : i + 4], strict=True)), strict=True))) for i in range(0, len(rows), 4)]
    want = sorted(tuple(x.values()) for a in range(1, 6) for x in suffix_dedup._shard_spans([x[1:] for x in rows if x[0] == a]).to_pylist())
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", size)
    got = list(suffix_dedup._sorted_shards(iter(batches)))
    assert len(got) == {1: 5, 900: len(got), 1 << 30: 1}[size] and want and sorted(tuple(x.values()) for b in got for x in b.to_pylist()) == want
    assert list(suffix_dedup._sorted_shards(iter([]))) == []
