"""Each operator against brute force on small fixtures with the odd cases: nulls, empties, repeats, ties, clashes."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import chat, decontam, minhash, packing, quality, queries, secret_scan, sharding, suffix_dedup, topk, urlfilter

from ..conftest import DATA, same_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"src{i % 3}" if i % 7 else None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=400):
    return " ".join("w" + str(rng.randrange(words)) for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    base = prose(rng, 300, 5000)
    hot = prose(rng, 120, 5000)
    edits = []
    for _ in range(6):
        w = base.split()
        w[rng.randrange(len(w))] = "edited"
        edits.append(" ".join(w))
    return [None, "", " \n\t ", "one", "one two", base, base, *edits, hot + " a", "b " + hot, hot * 2, "é" * 500, "x" * 3000, prose(rng, 20000, 9000)]


def test_sql_queries(spark, duck):
    for name, sql in queries.ORACLE_SQL.items():
        same_rows(queries.QUERIES[name](spark, f"{DATA}/sf0.001"), duck, sql)


def removed_by_hand(texts, depth=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + depth] for b in data for i in range(len(b) - depth + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i : i + depth] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes() if b else b""
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if b else 0
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block", [None, 3000])
def test_suffix_dedup(spark, odd_texts, block):
    got = suffix_dedup.remove_repeats(docs_of(spark, odd_texts).withColumn("block", F.lit("clash")), block_bytes=block).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == dict(enumerate(removed_by_hand(odd_texts)))
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).count() == 0


def test_suffix_dedup_passes_over_one_block(odd_texts, monkeypatch):
    """Rows may come in another order to each pass, and no pass hashes what an earlier one can tell it by a bit."""
    rng, hashed = random.Random(5), []
    mix = suffix_dedup.mix
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: hashed.append(len(x)) or mix(x))
    job, key = suffix_dedup.Job(200, 20, 3), (pa.scalar(2),)

    def run(texts):
        rows = list(enumerate(texts))
        block = lambda: pa.table(dict(zip(("doc_id", "text"), map(list, zip(*rng.sample(rows, len(rows)))))), pa.schema({"doc_id": pa.int64(), "text": pa.string()}))
        empty = pa.table({"block": [], "level": [], "bucket": [], "bits": []}, pa.schema({"block": pa.int32(), "level": pa.int32(), "bucket": pa.int32(), "bits": pa.binary()}))
        job.names0(key, block())
        told = job.names1(key, block(), empty)
        told = [suffix_dedup._answer(1, 3)((b,), told.filter(pc.equal(told["bucket"], b))) for b in told["bucket"].unique()]
        return [tuple(r.values()) for r in job.removed(key, block(), pa.concat_tables(told)).sort_by("doc_id").to_pylist()]

    many = [*odd_texts, *odd_texts[::2], "x" * 250_000, None, ""]
    assert [r[1:] for r in run(many)] == removed_by_hand(many)
    hashed.clear()
    plain = ["".join(chr(rng.randrange(33, 127)) for _ in range(30_000)) for _ in range(8)]
    assert [r[2] for r in run(plain)] == [0] * 8
    assert sum(hashed) < 2.1 * sum(map(len, plain)) * len(suffix_dedup.COVER) / suffix_dedup.MODULUS
    assert run([None, ""])[0][1:4] == (0, 0, 0)


def test_cover_meets_every_distance():
    c, v = suffix_dedup.COVER, suffix_dedup.MODULUS
    assert {(a - b) % v for a in c for b in c} == set(range(v))


def test_suffix_dedup_on_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in queries.op1_suffix_dedup(spark, f"{DATA}/sf0.001").collect()}
    assert got == dict(zip([r.doc_id for r in rows], removed_by_hand([r.text for r in rows])))


def test_chat_round_trip(spark):
    ugly = ["~", "~0", "~1INST]", "</s>", "[INST]", "[/INST][INST]", "<<s>", "a~2b</s></s>", "", None, "\n", "é🙂[INST", "</s" + ">"]
    rows = [(i % 4 if i % 5 else None, i // 4, ["user", "assistant", None, "to\nol</s>"][i % 4], t) for i, t in enumerate(ugly * 3)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    want = defaultdict(list)
    for c, turn, role, text in rows:
        want[c].append((turn, role or "", text or ""))
    assert len(out) == len(want)
    for r in out:
        assert [tuple(t) for t in r.back] == [t[1:] for t in sorted(want[r.conv_id])]
        assert r.formatted.count("</s>") == r.formatted.count("[INST]") == r.n_turns
        assert [s.loss for s in r.segments].count(True) == sum(t[1] == "assistant" for t in want[r.conv_id])
    assert chat.format_chats(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    """One text of some megabytes through the operators that do not have such a test of their own."""
    rng = random.Random(17)
    long = prose(rng, 400_000, 30_000) + " [INST] ~ é"
    turns = spark.createDataFrame([(1, 0, "user", "short"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    (chat_row,) = chat.format_chats(turns).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    assert [t.text for t in chat_row.back] == ["short", long] and [s.text for s in chat_row.segments if s.loss] == [long.replace("~", "~0").replace("[INST]", "~1INST]")]
    docs = docs_of(spark, [long, "x", None])
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in sharding.interleaved_shards(docs).collect()}
    assert sizes[0] == (len(long.encode()) + 8, zlib.crc32(long.encode()))
    scores = quality.score_quality(docs, quality.fit_quality(docs, spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))).collect()
    assert len(scores) == 3 and all(0 <= r.score <= 1 for r in scores)
    key = hashlib.sha1(b"long").hexdigest()
    found = secret_scan.scan(docs_of(spark, [long + f' token = "{key}" end'])).first().findings
    assert [(f.start, f.candidate) for f in found if f.is_secret] == [(len(long) + 10, key)]


def test_chat_machine(spark):
    talks = {1: "sua", 2: "uau", 3: "a", 4: "uu", 5: "usa"}
    names = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(c, i, names[r], "t") for c, t in talks.items() for i, r in enumerate(t)]
    got = {r.conv_id: r.n_bad_turns for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2}


def test_decontamination_short_items_and_clashes(spark):
    texts = ["The quick, brown fox!", "nothing here", None, "", "QUICK brown", "a b c d e f g h i j k l", "x b c d e f g h i j k y", "a b c d e f g h i j k l", "b c d e f g h i j"]
    items = [(1, "quick BROWN"), (2, "a b c d e f g h i j k"), (3, None), (4, "..."), (5, "nothing"), (5, "nothing"), (None, "here")]
    docs = docs_of(spark, texts).withColumn("n_hit", F.lit("clash")).withColumn("words", F.lit(0)).withColumn("g", F.lit(0))
    out = {r.doc_id: r for r in decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [out[i].n_hit for i in range(9)] == [2, 2, 0, 0, 2, 11, 10, 11, 0]
    assert [out[i].n_words for i in range(9)] == [4, 2, 0, 0, 2, 12, 12, 12, 9]
    assert [list(out[i].items) for i in range(9)] == [["1"], ["5"], [], [], ["1"], ["2"], ["2"], ["2"], []]
    assert decontam.decontaminate(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    none = decontam.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == 9


def test_decontamination_by_shuffles_copies_and_long_texts(spark):
    """Nothing broadcast; many copies of one text, null ids, items that share a window, a long text."""
    rng = random.Random(4)
    item = prose(rng, 30, 50_000)
    hot = "x " + item + " y"
    texts = [hot] * 40 + [prose(rng, 30_000, 50_000) + " " + " ".join(item.split()[:10]) + " end", " ".join(item.split()[:9]) + " z"]
    ids = [None if i < 20 else i for i in range(len(texts))]
    items = [(f"i{j}", item) for j in range(3)] + [("part", " ".join(item.split()[5:15])), ("short", " ".join(item.split()[20:24]))]
    kept = decontam.BROADCAST_WINDOWS, decontam.BROADCAST_DOCUMENTS
    for limit in (kept, (0, 0)):
        decontam.BROADCAST_WINDOWS, decontam.BROADCAST_DOCUMENTS = limit
        out = decontam.decontaminate(docs_of(spark, texts, ids), spark.createDataFrame(items, "item_id string, text string")).collect()
        got = Counter((r.n_words, r.n_hit, tuple(r["items"])) for r in out)
        assert got == {(32, 30, ("i0", "i1", "i2", "part", "short")): 40, (30_011, 10, ("i0", "i1", "i2")): 1, (10, 0, ()): 1}
    decontam.BROADCAST_WINDOWS, decontam.BROADCAST_DOCUMENTS = kept


def test_url_rules(spark):
    urls = {
        "http://a.com/en/1": ("com/en/", "block"), "https://www.EXAMPLE.com/en/75?x": ("example.com/en/7", "allow"),
        "http://example.com/EN/7": (None, "allow"), "http://notexample.com/en/7": ("com/en/", "block"),
        "http://x.example.net/de/8": ("example.net/de/8", "block"), "http://x.example.net/de/9": ("net/de/", "allow"),
        "http://org/es/": ("org/es/", "block"), "http://my-casino.example.org/": (None, "block"), "no scheme": (None, "allow"),
        "": (None, "allow"), "http://": (None, "allow"), "ftp://com/en": (None, "allow"), "http://com:80/en/": (None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate([*urls, None])] * 2
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    kept = urlfilter.MAP_RULES, urlfilter.BROADCAST_RULES
    for limits in (kept, (0, 10**6), (0, 0)):  # by literal map, by broadcast table, by shuffled table
        urlfilter.MAP_RULES, urlfilter.BROADCAST_RULES = limits
        got = urlfilter.filter_urls(df, urlfilter.RULES).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.rule, r.verdict) == urls.get(r.url, (None, "allow")), r.url
        assert urlfilter.filter_urls(df.limit(0), urlfilter.RULES).count() == 0
    urlfilter.MAP_RULES, urlfilter.BROADCAST_RULES = kept
    long = spark.createDataFrame([(1, "http://x.org/" + "a/" * 200_000 + "casino/")], "page_id long, url string")
    assert [r.verdict for r in urlfilter.filter_urls(long, urlfilter.RULES).collect()] == ["block"]
    assert urlfilter.filter_urls(df, []).where("verdict <> 'allow'").count() == 0


def test_many_url_rules(spark):
    """A list beyond the literal index, against every rule run on every URL."""
    rng = random.Random(12)
    names = [f"{rng.choice('abcdef')}{rng.randrange(400)}.{rng.choice(['com', 'net'])}/{rng.choice(['', 'p/', 'p/q'])}" for _ in range(900)]
    rules = [urlfilter.host_path_rule(rng.choice(["allow", "block"]), n) for n in dict.fromkeys(names)]
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice('abcdef')}{rng.randrange(400)}.{rng.choice(['com', 'net'])}/{rng.choice(['p/q1', 'x', 'p/z'])}" for _ in range(200)]
    kept, urlfilter.MAP_RULES = urlfilter.MAP_RULES, 100
    got = urlfilter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()
    urlfilter.MAP_RULES = kept
    import re

    for r in got:
        fit = [x for x in rules if re.search(x.regex, r.host + r.path)]
        best = max(fit, key=lambda x: (x.rank, x.rule), default=None)
        assert (r.rule, r.verdict) == ((best.rule, best.verdict) if best else (None, "allow"))


def test_shards(spark):
    rng = random.Random(3)
    texts = [rng.choice([None, "", "same", "é" * rng.randrange(9)]) for _ in range(1000)]
    ids = [rng.choice([None, i, 7]) for i in range(1000)]
    df = docs_of(spark, texts, ids).withColumn("source", F.when(F.rand(1) < 0.4, "hot").otherwise(F.col("source"))).withColumn("h", F.lit(1))
    df = spark.createDataFrame(df.collect(), df.schema)
    rows = sharding.interleaved_shards(df).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts)
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(slots) == 24 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    mix = Counter((r.shard, r.source) for r in rows)
    for source, n in Counter(r.source for r in rows).items():
        assert all(abs(mix[s, source] - n / 24) <= 2 for s in range(24))
    assert sharding.interleaved_shards(df.limit(0)).count() == 0
    assert sharding.interleaved_shards(df.limit(3)).count() == 3
    tiny = docs_of(spark, ["t"] * 900).withColumn("source", F.col("doc_id").cast("string"))  # sources of one row
    sizes = Counter(r.shard for r in sharding.interleaved_shards(tiny).collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    again = [sorted(map(tuple, sharding.interleaved_shards(x).collect())) for x in (tiny, tiny.repartition(7))]
    assert again[0] == again[1]  # the layout of the input does not matter


def test_shards_by_hand(spark):
    """The interleaving again, from the ranks inside each source."""
    df = docs_of(spark, [f"text {i % 50}" for i in range(400)]).withColumn("source", F.expr("if(doc_id % 3 = 0, 'hot', concat('s', doc_id % 17))"))
    rows = sharding.interleaved_shards(df).collect()
    n = Counter(r.source for r in rows)
    seen = Counter()
    fracs = []
    for r in sorted(rows, key=lambda r: r.pos):
        fracs.append((seen[r.source] + int(hashlib.md5(f"interleave-1/s{r.source}".encode()).hexdigest()[:6], 16) / (1 << 24)) / n[r.source])
        seen[r.source] += 1
    assert fracs == sorted(fracs) and [r.pos for r in sorted(rows, key=lambda r: r.pos)] == list(range(400))
    assert all(r.shard == r.pos * 24 // 400 for r in rows)


def test_packing(spark, odd_texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    tricky = ["It's 'tis, isn't A.B.C é, x́, a b c 12,345.67!!", "İSTANBUL ΑΣ ΑΣ. \x1c\x1f a\x85b", "don't.stop...now|| #a_b%"]
    tricky += ["a <|endoftext|> b", "<|startoftext|><|endoftext|>x<|EndOfText|>", "T\u0308 J\u030c H\u0331 A\u0301", ". \u0338 .\u0338a", "<|endoftext"]
    texts = odd_texts + tricky * 2
    ids = [None if i == 3 else i % 15 for i in range(len(texts))]
    rows = packing.pack_documents(docs_of(spark, texts, ids).withColumn("length", F.lit(0)), queries.tokenizer_path()).collect()
    want = Counter()
    for i, t in zip(ids, texts):
        own = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for size in packing.cut(len(own), packing.piece_sizes(2048, 64)):
            want[i, at, size, zlib.crc32(own[at : at + size].tobytes()), len(own)] += 1
            at += size
        assert at == len(own)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(seqs) == math.ceil(total / 2048) or total / len(seqs) / 2048 > 0.97
    assert packing.pack_documents(docs_of(spark, []), queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_are_those_of_the_file(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(9)
    pieces = [*"aZ09 .,;:!?|'\n\t<>é́ß̈Tİ", "T\u0308", "'s", "don't", "<|endoftext|>", "<|startoftext|>", "endoftext|>", "<|", "  ", "ⅷ", "\u2028", "日本"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(4000)]
    path = public_tokenizers.path(name)
    tok, own = Tokenizer.from_file(path), packing.WordTokens(path)
    ids, bounds = own.encode(pa.array(texts))
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_plain_words_are_encoded_many_at_once(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng, texts_seen = public_tokenizers.path("word_bpe_49k.json"), random.Random(3), []
    tok, own = Tokenizer.from_file(path), packing.WordTokens(path)
    encoded = own._encoded
    monkeypatch.setattr(own, "_encoded", lambda texts, *a: texts_seen.extend(texts) or encoded(texts, *a))
    latin = "".join(map(chr, range(0xC0, 0x100))).replace("×", "").replace("÷", "")
    words = ["".join(rng.choice("abcdefgABCDEFG" + latin) for _ in range(rng.randrange(1, 9))) for _ in range(6000)]
    marks = [chr(i) for i in range(33, 127) if not chr(i).isalnum()]
    texts = [" ".join(w + rng.choice(marks) * rng.randrange(3) for w in words[i : i + 20]) for i in range(0, len(words), 20)]
    texts += [f"a{m}\u0338 é{m}\u0308b É{m}s e\u0301{m}x 7{m}ll" for m in marks] + [w + "\u0301" for w in words[:50]]
    ids, bounds = own.encode(pa.array(texts))
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids, t
    assert len(texts_seen) < len(words) / 5  # the words in runs, and chunks that hold more than letters
    own.ends[:] = False  # a vocabulary that does not show where words end
    own.reset()
    assert own.encode(pa.array(texts))[0].tolist() == ids.tolist()


def test_secret_scan(spark):
    key = hashlib.sha1(b"k").hexdigest()
    texts = [None, "", f'the token = "{key}" and', f'TOKEN = "{key.upper()}"!!', f"commit {key} of", "card 4111222233334444 on", "z" * 5000, f'password: "{key}" ' * 200]
    df = docs_of(spark, texts).withColumn("findings", F.lit(1))
    out = {r.doc_id: r.findings for r in secret_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        for f in out[i]:
            assert t[f.start : f.start + f.length] == f.candidate
    assert [sum(f.is_secret for f in out[i]) for i in range(8)] == [0, 0, 1, 1, 0, 0, 0, 200]
    red = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert [red[i] for i in range(7)] == [None, "", 'the token = "[SECRET]" and', 'TOKEN = "[SECRET]"!!', texts[4], texts[5], texts[6]]
    assert red[7] == 'password: "[SECRET]" ' * 200
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_secret_scan_long_names(spark):
    key = hashlib.sha1(b"long").hexdigest()
    names = ["DATABASE_ACCESS_TOKEN", "AWS_SECRET_ACCESS_KEY", "my_service_private_key", "PRODUCTION_API_KEY_2"]
    texts = [f"{n}{a}{key}{b}" for n in names for a, b in (("=", ""), ('="', '"'), (" = '", "'"), (": ", " "))]
    texts.append(f"é {names[0]}={key} {names[1]}={key}")
    out = {r.doc_id: r.findings for r in secret_scan.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(f.start, f.candidate) for f in out[i] if f.is_secret] == [(j, key) for j in range(len(t)) if t.startswith(key, j)], t
    # padding stays with the key
    padded = "QUJDREVGR0hJSktMTU5PUFFSU1RVVld4eXoxMjM0NTY3OA=="
    (found,) = secret_scan.scan(docs_of(spark, [f'token = "{padded}" and'])).collect()[0].findings
    assert found.candidate == padded


def held_out_findings(rng):
    """Texts with one secret, and texts with none, in forms and names that the labelled findings do not have."""
    import base64
    import string

    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    b64 = lambda n: base64.b64encode(rng.randbytes(n)).decode()
    true = [
        ("SLACK_BOT_TOKEN=", mixed(30), "\nPORT=8080"), ("spring.datasource.password: ", "S3cure" + mixed(3) + "!", "\n"),
        ("  aws_secret_access_key = ", b64(30)[:40].replace("=", "A"), "\n"), ("curl -H 'Authorization: Bearer ", "eyJ" + mixed(40), "' https://x.io"),
        ("deploy with ", "ghp_" + mixed(36), " today"), ("mysql://backup:", "B4ckup" + mixed(4), "@10.1.1.5/app"), ('"clientSecret": "', hexes(40), '",'),
        ("login password='", "tulip" + str(rng.randrange(10, 999)) + "$", "' for staging"), ("STRIPE_KEY: ", "sk_live_" + mixed(24), ""), ("the passphrase = ", mixed(9) + "%" + mixed(3), " ok"),
    ]
    false = [
        "merged commit " + hexes(40) + " into main", "docker pull repo@sha256:" + hexes(64), "see https://git.example.org/a/b/blob/" + hexes(40) + "/README.md",
        "GET /static/js/main." + hexes(20) + ".chunk.js", "password: required field", "the token: whatever comes next", "uuid " + f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}",
        'password = "changeme"', "api_key: ${API_KEY}", "order 20210405123456789 shipped", "an antidisestablishmentarianism debate", "call getUserAccessTokenFromCacheV2 now",
        "secret: something nobody knows", "time=12:30:45, level=warning", "ratio: 0.123456789012345678", "file report_2021_03_final_version_2.pdf", "md5 = " + hexes(32), "key = 1000000", "The answer: Nevertheless!",
    ]
    return true, false


def test_secret_scan_on_held_out_forms(spark):
    rng = random.Random(21)
    texts, want = [], []
    for _ in range(30):
        true, false = held_out_findings(rng)
        texts += [f"some words before {a}{v}{b}" for a, v, b in true] + [f"some words before {t}" for t in false]
        want += [(len("some words before " + a), v) for a, v, _ in true] + [None] * len(false)
    out = {r.doc_id: r.findings for r in secret_scan.scan(docs_of(spark, texts)).collect()}
    said = [{(f.start, f.candidate) for f in out[i] if f.is_secret} for i in range(len(texts))]
    hit = sum(w in s for w, s in zip(want, said) if w)
    recall, precision = hit / sum(w is not None for w in want), hit / max(1, sum(len(s) for s in said))
    print(f"held-out forms: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9


def test_secret_model_on_a_held_out_split(spark):
    found = secret_scan.labelled_findings(spark)
    held = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4)) == 0
    row = secret_scan.measured(found.where(held), secret_scan.train(found.where(~held))).first()
    print(f"held-out split: {row}")
    assert row.precision >= 0.95 and row.recall >= 0.95 and row.true_findings > 500


def test_secret_candidates_by_hand(spark):
    """Every candidate of the docstring's rule, found again with a plain scanner."""
    import re

    rng = random.Random(8)
    parts = ["word ", "token", "Key", " = ", ":", "=", '"', "'", "a1b2c3d4e5f6a7b8", "ABCdef", "0123456789012345", "://u:", "p4ss!w", "@host/", "/", "é", "\n", "hunter2!x", "==", ", ", "_x-", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(300)]
    key = re.compile(r"[A-Za-z0-9_+/-]{16,}={0,2}\Z")
    for r in secret_scan.scan(docs_of(spark, texts)).collect():
        t, want = texts[r.doc_id], []
        for m in re.finditer(r"([:=][ \t]{0,2}[\"']?)(?![/=:])((?:(?![\"'<>,;()])[!-~]){6,128})|[A-Za-z0-9_+/-]{16,}={0,2}", t):
            sign, c = m[1] or "", m[2] or m[0]
            login = re.match(r":([^\s@/]{1,128})@", m[0])
            in_url = bool(login and re.search(r"://[^\s/:@]*\Z", t[max(0, m.start() - 32) : m.start()]))
            if in_url:
                c = login[1]
            elif sign:
                c = re.sub(r"(?<=[A-Za-z0-9])[.:?]\Z", "", c)
            at = m.start() + len(sign)
            rich = re.search(r"\A(?=.*[0-9])(?=.*[A-Za-z])|[a-z][A-Z]", c)
            near = re.search(secret_scan.NEAR, t[max(0, at - 32) : at])
            if (key.match(c) and rich) or in_url or (sign and len(c) >= 6 and near):
                want.append((at, c))
        assert [(f.start, f.candidate) for f in r.findings] == want, t


def test_corpus_words_by_hand(spark):
    texts = ["the house and the House", "house, tree tree.tree", None, "", "x" * 30, "éhouse tree2 a_tree"] + ["same"] * 3
    assert secret_scan.corpus_words(docs_of(spark, texts)) == ["tree", "house", "same"]
    assert secret_scan.corpus_words(docs_of(spark, []), most=5) == []


def test_secret_scan_on_the_table(spark):
    import re

    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()
    got = queries.op7_secret_scan(spark, f"{DATA}/sf0.01").collect()
    true = {(d.doc_id, m.start(1)) for d in docs for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', d.text or "")}
    assert {(r.doc_id, r.start) for r in got if r.is_secret} == true and true


def top_by_hand(rows, k=5):
    """Unbounded integers over all pairs; scores as a long shows them."""
    ok = [(v, [int(x) * 256 if abs(x) >= 2.0**53 else math.floor(x * 256) for x in e]) for v, e in rows if v is not None and e and None not in e and np.isfinite(e).all()]
    want = Counter()
    for a, (v, q) in enumerate(ok):
        if v % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, w)), u) for b, (u, w) in enumerate(ok) if b != a and len(w) == len(q))[:k]
            want.update((v, i + 1, u, max(-(1 << 63), min((1 << 63) - 1, -s))) for i, (s, u) in enumerate(best))
    return want


@pytest.fixture
def small_shards():
    kept = topk.SHARD_ROWS, topk.BLOCK_QUERIES, topk.ROOTS, topk.NEXT
    topk.SHARD_ROWS, topk.BLOCK_QUERIES, topk.ROOTS, topk.NEXT = 90, 20, 3, 2
    yield
    topk.SHARD_ROWS, topk.BLOCK_QUERIES, topk.ROOTS, topk.NEXT = kept


def vectors_with_odd_rows():
    rng = np.random.default_rng(1)
    f32 = lambda x: [float(np.float32(v)) for v in x]
    rows = [(i, f32(rng.normal(size=6))) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(50, rows[0][1]), (50, rows[3][1])]
    rows += [(2000, None), (2050, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (2200, [])]
    return rows + [(None, rows[1][1]), (2250, [1.0, 2.0]), (2251, [3.0, 4.0])]


def test_top_k(spark):
    rows = vectors_with_odd_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(1)).withColumn("shard", F.lit("clash"))
    assert Counter(tuple(r) for r in topk.top_k(df).collect()) == top_by_hand(rows)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_in_waves_over_many_shards(spark, small_shards):
    rows = vectors_with_odd_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert Counter(tuple(r) for r in topk.top_k(df).collect()) == top_by_hand(rows)


def test_top_k_of_large_components(spark, small_shards):
    """Finite components of any size are exact: next to ordinary rows, beyond 2**52, beyond a long, beyond float64's squares."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    rows += [(300 + i, [4e4 * s, *([-4e4] * 7)]) for i, s in enumerate((1, -1, 2))]
    rows += [(350, [1e30] * 8), (400, [1e30, 1e14, 0.7, *([0.0] * 5)]), (401, [1e30, 1e14, 0.9, *([0.0] * 5)]), (402, [-1e30] * 8)]
    rows += [(450, [1.7e308] * 8), (451, [1e307, -1.7e308, *([3.5] * 6)]), (500, [2.0**53 + 2, 0.5, *([2.0**45 + 0.25] * 6)]), (550, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in topk.top_k(df).collect()) == top_by_hand(rows)


def test_quality(spark):
    d = f"{DATA}/sf0.01"
    rows = queries.op9_quality(spark, d).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_quality_odd_rows(spark, odd_texts):
    docs = docs_of(spark, odd_texts, [None, *range(1, len(odd_texts))])
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (2, 0, 0), (5, None, 0), (None, 1, 0), (6, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0), labels.where("quality = 1")):
        out = quality.score_quality(docs, quality.fit_quality(docs, given)).collect()
        assert len(out) == len(odd_texts) and all(0 <= r.score <= 1 for r in out)
    clash = docs.withColumn("score", F.lit("x"))
    assert quality.score_quality(clash, quality.fit_quality(docs, labels), extra=("score", "lang")).columns == ["lang", "doc_id", "held_out", "score", "predicted"]
    model = quality.fit_quality(docs.limit(0), labels)
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_quality_fit_does_not_depend_on_row_order(spark, odd_texts):
    rng = random.Random(6)
    texts = [prose(rng, 30 + i % 7, 100) for i in range(80)] + [prose(rng, 200_000, 9000)]
    docs = docs_of(spark, texts, [i % 40 for i in range(len(texts))])  # ids with two texts each
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    models = [quality.fit_quality(d, labels) for d in (docs, docs.orderBy(F.col("text").desc()), docs.repartition(9))]
    assert all((m.value == models[0].value).all() and (m.threshold == models[0].threshold).all() for m in models)


def test_statistics_by_hand():
    x = quality.statistics(pa.array(["aa bb aa aa\nBB", None, "", "é!"]))
    f = dict(zip(quality.FEATURES, x[0]))
    assert f["words"] == pytest.approx(math.log1p(5)) and f["distinct_words"] == 3 / 5 and f["repeated_next"] == 1 / 5
    assert f["upper"] == 2 / 14 and f["lower"] == 8 / 14 and f["distinct_lines"] == 1
    assert not x[1][:2].any() and x[3][quality.FEATURES.index("non_ascii")] == 2 / 3


def classes_by_hand(texts, least=0.8):
    def parts(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [parts(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if (texts[i] or "") == (texts[j] or "") or (u and sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * u):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_dedup(spark, odd_texts):
    docs = docs_of(spark, odd_texts).withColumn("tkey", F.lit(1)).withColumn("key", F.lit(1))
    got = {r.doc_id: r.class_id for r in minhash.near_classes(docs).collect()}
    assert [got[i] for i in range(len(odd_texts))] == classes_by_hand(odd_texts)
    assert minhash.near_classes(docs.limit(0)).count() == 0
    nulls = minhash.near_classes(docs_of(spark, ["a b", "a b", "c"], [None, None, 4])).collect()
    assert sorted((str(r.class_id), r.class_docs) for r in nulls) == [("4", 1), ("None", 2), ("None", 2)]


def test_near_dedup_in_a_large_group(spark):
    """Variants of one template that are similar in pairs, but to no centre: their buckets hold several hundred."""
    rng = random.Random(11)
    base, texts = [f"t{i}" for i in range(179)], []
    for i in range(120):  # 179 of 221 shingles in common, 175 of 225 with every other text
        pair = base + [f"pair{i}x{j}" for j in range(4)]
        texts += [" ".join(pair + [f"own{i}{side}{j}" for j in range(21)]) for side in "ab"]
    for i in range(60):  # a linked group in the same buckets
        w = base + [f"c{j}" for j in range(25)]
        w[rng.randrange(199, 204)] = f"copy{i}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    want = classes_by_hand(texts)
    assert len(set(want)) == 121
    got = {r.doc_id: r.class_id for r in minhash.near_classes(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    # the join itself, without bands or centres
    nodes = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "nid long, label long, text string")
    minhash.SHINGLE_BLOCK = 50
    pairs = {tuple(r) for r in minhash.rare_pairs(nodes.select("nid", "label"), minhash.shingle_sets(nodes.select("nid", "text"), 5), 0.8).collect()}
    minhash.SHINGLE_BLOCK = 512
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    close = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert close <= pairs and len(pairs) < 2 * len(close)


@pytest.mark.parametrize("edits", [13])
def test_near_dedup_of_a_family_around_the_threshold(spark, edits):
    """400 texts of 1000 words, each with some edits of one base: pairs lie on both sides of 0.8."""
    rng = random.Random(edits)
    base, texts = [f"b{i}" for i in range(1000)], []
    for i in range(400):
        w = list(base)
        for j in rng.sample(range(1000), edits):
            w[j] = f"e{i}x{j}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.class_id for r in minhash.near_classes(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_hand(texts)


def test_near_dedup_exact_mode_needs_no_band(spark):
    rng = random.Random(2)
    base, texts = [f"b{i}" for i in range(300)], ["x y", "", None]
    for i in range(30):
        w = list(base)
        w[rng.randrange(300)] = w[rng.randrange(300)] = f"e{i}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.class_id for r in minhash.near_classes(docs_of(spark, texts), k=4, bands=1, exact=True).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_hand(texts)


def test_near_dedup_on_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r.class_id for r in queries.op10_near_dedup(spark, f"{DATA}/sf0.001").collect()}
    assert [got[r.doc_id] for r in rows] == [rows[i].doc_id for i in classes_by_hand([r.text for r in rows])]


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    wa, wb = rng.integers(1, 5, 200).astype(float), rng.integers(1, 5, 200).astype(float)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    sig = minhash.dart_signatures(np.r_[e, e], np.r_[np.zeros(200, int), np.ones(200, int)], 2, 2048, np.r_[wa, wb])
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05
    again = minhash.dart_signatures(np.r_[e, e[:50]], np.zeros(250, int), 1, 64)
    assert (again == minhash.dart_signatures(e, np.zeros(200, int), 1, 64)).all()


@pytest.mark.parametrize("most", [0, 100])
def test_bridges(spark, most):
    kept, minhash.BRIDGES = minhash.BRIDGES, most
    labels = spark.createDataFrame([(i, i // 10 * 10) for i in range(50)], "nid long, label long")
    edges = spark.createDataFrame([(3, 14), (12, 49), (60, 61), (25, 70), (1, 2)], "a long, b long")
    got = {r.nid: r.label for r in minhash.bridged(labels, edges).collect()}
    minhash.BRIDGES = kept
    want = {i: {1: 0, 4: 0}.get(i // 10, i // 10 * 10) for i in range(50)}
    assert got == {**want, 60: 60, 61: 60, 70: 20}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.nid: r.label for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
