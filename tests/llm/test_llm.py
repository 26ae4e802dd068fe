"""The training-data operators: brute force, round trips, accuracy, and edge cases."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyspan.llm import decontamination, jaccard, language_id, mixing, pii, suffix_dedup, telephony, toxicity, url_filter, warc

DOC = "doc_id bigint, text string, lang string, source string"


def docs(spark, *rows):
    return spark.createDataFrame([(*r, *(None,) * (4 - len(r))) for r in rows], DOC)


# --- 1


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_decontamination(spark):
    item, short = passage(1, 40), "two words"
    words = item.split()
    edited = " ".join([*words[:20], "changed", *words[21:]])
    bench = spark.createDataFrame([(1, item), (2, short), (3, None), (4, ""), (None, item)], "item_id bigint, text string")
    d = docs(spark, (1, f"{passage(2, 60)} {item.upper()}! {passage(3, 9)}"), (2, passage(4, 100)), (3, f"x {short}."), (4, None), (5, ""), (6, edited), (6, edited), (7, " ".join(words[:20])))
    got = {}
    for r in decontamination.mark(d.withColumn("leaks", F.lit("taken")), bench).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*").collect():
        got.setdefault(r.doc_id, []).append((r.item_id, round(r.similarity, 3), r.start_word))
    # one word changed: five of 36 shingles differ either way
    assert got == {1: [(1, 1.0, 60)], 3: [(2, 1.0, 1)]} and 31 / 41 < 0.8
    assert sorted(r.doc_id for r in decontamination.clean(d, bench).collect()) == [2, 4, 5, 6, 6, 7]
    assert decontamination.mark(d.limit(0), bench).count() == 0 and decontamination.clean(d, bench.limit(0)).count() == 8


def test_decontamination_is_the_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    items = [[r.choice(words) for _ in range(r.choice([5, 8, 30, 60]))] for _ in range(8)]
    texts = []
    for _ in range(30):
        own = list(r.choice(items))
        if r.random() < 0.5:
            own[r.randrange(len(own))] = "other"
        texts.append([r.choice(words) for _ in range(r.randrange(20))] + own + [r.choice(words) for _ in range(r.randrange(20))])
    shingle = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    index = decontamination.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    for t in texts:
        want = {}
        for i, w in enumerate(items):
            size = min(len(w), len(t))
            a = shingle(w)
            best = max(((lambda b: (a & b).total() / (a | b).total())(shingle(t[s : s + size])) for s in range(len(t) - size + 1)), default=0)
            if best >= 0.8:
                want[i] = round(best, 9)
        assert {x["item_id"]: round(x["similarity"], 9) for x in index.leaks(" ".join(t))} == want


def test_near_copies_are_within_the_radius():
    """Recall of the fingerprints on edited copies against exact search over all windows."""
    r = random.Random(21)
    items = [[f"w{r.randrange(3000)}" for _ in range(r.choice([30, 60, 120]))] for _ in range(60)]
    index = decontamination.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    exact = decontamination.Index([(i, " ".join(w)) for i, w in enumerate(items)], radius=64)
    caught = there = 0
    for n, w in enumerate(items * 10):
        own = list(w)
        for _ in range(r.randrange(1, 1 + len(own) // 40 + 1)):
            own[r.randrange(len(own))] = "other"
        t = " ".join([f"x{r.randrange(3000)}" for _ in range(40)] + own)
        want, got = ({x["item_id"] for x in k.leaks(t)} for k in (exact, index))
        there, caught = there + len(want), caught + len(got & want)
    assert there > 200 and caught >= 0.97 * there


def test_decontamination_by_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, passage(i, 30)) for i in range(12)], "item_id bigint, text string")
    d = docs(spark, *[(i, f"{passage(90 + i, 20)} {passage(i, 30)} {passage(i + 1, 30)}") for i in range(11)], (50, None), (51, ""), (3, passage(3, 30)), (3, passage(3, 30)), (60, passage(70, 5000)))
    d = d.withColumn("__text", F.lit("mine")).withColumn("Leaks", F.lit("taken"))
    rows = lambda: sorted((r.doc_id, r["__text"], [x.item_id for x in r.leaks]) for r in decontamination.mark(d, bench).collect())
    whole = rows()
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 100)
    assert rows() == whole and [x for _, _, x in whole if x][:2] == [[0, 1], [1, 2]]


def test_hamming_blocks_find_all():
    r = np.random.default_rng(1)
    prints = r.integers(0, 2**63, 50, dtype=np.uint64)
    near = prints[:20] ^ np.uint64(0b1011 << 17)
    index = decontamination.HammingIndex(prints, 3)
    assert {(q, i) for q, i, _ in index.within(near)} >= {(i, i) for i in range(20)}


# --- 2


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_jaccard_join_is_the_brute_force(spark):
    r = random.Random(11)
    words, rows = [f"w{i}" for i in range(50)], []
    while len(rows) < 150:
        base = [r.choice(words) for _ in range(r.choice([3, 6, 12, 16, 26, 60, 120]))]
        for _ in range(r.choice([1, 2, 5])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(900, ""), (901, None), (902, " \t ")]
    d = docs(spark, *rows).withColumn("component_id", F.lit("taken"))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(d, jaccard.Measure(4, 85)).collect()}
    assert got == brute_components(rows, 4, 85)


def test_jaccard_join_on_near_copies_of_one_text(spark):
    """A dense group: copies of one text with up to five edits, of which some link only through others."""
    r = random.Random(31)
    words = [f"w{i}" for i in range(400)]
    base, line = [r.choice(words) for _ in range(150)], [r.choice(words) for _ in range(25)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(i % 6):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(200 + i, " ".join([r.choice(words) for _ in range(60)] + line)) for i in range(40)]
    rows += [(300 + i, " ".join(base[i : i + 12])) for i in range(3)] + [(400, " ".join(words * 30)), (401, " ".join(words * 30 + ["end"]))]
    d = docs(spark, *rows).repartition(7)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(d, jaccard.Measure(4, 85)).collect()}
    assert got == brute_components(rows, 4, 85)


def test_subsets_link_all_of_a_bucket(spark):
    """Three sets of one size that each link with a larger one only."""
    low, high = jaccard.Measure(1, 80), [f"h{i}" for i in range(12)]
    rows = [(i, " ".join(high[:i] + high[i + 1 :][:10] + [f"x{i}"] * 0)) for i in range(5)] + [(9, " ".join(high))]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(docs(spark, *rows), low).collect()}
    assert got == brute_components(rows, 1, 80)


def test_shared_streams_tokens_over_batches():
    import pandas as pd

    rows = [(1, -1), (1, 5), (1, 5), (2, 7), (3, 4), (3, 4), (3, 6), (3, 8), (4, -1), (5, 1), (5, 2)]
    for size in (1, 2, 3, 20):
        frames = (pd.DataFrame(rows[a : a + size], columns=["token", "cls"]) for a in range(0, len(rows), size))
        assert sorted(x for f in jaccard._shared(frames) for x in f["cls"]) == [1, 2, 4, 5, 6, 8]


def test_jaccard_join_of_nothing_and_of_null_ids(spark):
    got = jaccard.join(docs(spark, (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"))).collect()
    assert sorted(((x.doc_id, x.component_id) for x in got), key=str) == [(1, 1), (1, 1), (None, None)]
    assert jaccard.join(docs(spark).limit(0)).count() == 0


# --- 3


def test_mixing(spark):
    d = docs(spark, *[(i, f"t{i}", None, "big") for i in range(900)], *[(1000 + i, "x", None, "small") for i in range(100)], *[(2000 + i, None, None, None) for i in range(50)])
    got = mixing.mix(d, {"big": 1.0, "small": 3.0}, total=2000)
    counts = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(counts["big"] - 500) < 100 and abs(counts["small"] - 1500) < 200 and None not in counts
    assert got.groupBy("doc_id").agg(F.max("mix_copy").alias("m"), F.count("*").alias("n")).where("m <> n").count() == 0
    again = mixing.mix(d, {"big": 1.0, "small": 3.0}, total=2000)
    assert sorted(got.select("doc_id", "mix_copy").collect()) == sorted(again.select("doc_id", "mix_copy").collect())
    even = {r.source: r["count"] for r in mixing.mix(d.withColumn("mix_key", F.lit(1))).groupBy("source").count().collect()}
    assert all(abs(n - 350) < 110 for n in even.values()) and len(even) == 3
    assert mixing.mix(d.limit(0)).count() == 0
    same = docs(spark, *[(7, "x", None, "a")] * 4000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    dealt = mixing.mix(same, total=12_000).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = sum(r["count"] for r in dealt)
    assert whole % 4000 == 0 and (not whole or max(r["count"] for r in dealt) < 0.5 * whole)


def test_poisson_inversion(spark):
    u = spark.range(20_000).select(mixing.uniform("s", F.col("id")).alias("u"))
    row = u.select(mixing.inverse(mixing.poisson_cdf(F.lit(2.5)), F.col("u")).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
    assert abs(row[0] - 2.5) < 0.05 and abs(row[1] - 2.5) < 0.12


# --- 4


def test_warc_round_trip(spark, tmp_path):
    long = "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60
    rows = [(1, "http://a/\r\nx", long), (2, None, long), (5, "u", long), (5, "u", long), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (None, "u", long), (7, "u", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("taken"))
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path)
    assert sorted(((r.page_id, bytes(r.payload)) for r in records.where("record_type = 'response'").collect()), key=str) == sorted(((i, (t or "").encode()) for i, _, t in rows if i not in (1, 2)), key=str)
    got = sorted(((r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in warc.resolve_revisits(records).collect()), key=str)
    size, sha = len(long.encode()), hashlib.sha1(long.encode()).hexdigest()
    assert {x for x in got if x[3] == "revisit"} == {(1, size, sha, "revisit", 5), (2, size, sha, "revisit", 5)} and len(got) == len(rows)
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    heads = [h for f in spark.read.format("binaryFile").load(path).collect() for h, _ in warc.records(gzip.decompress(f.content))]
    ids = {h[b"warc-record-id"]: h for h in heads}
    revisits = [h for h in heads if h[b"warc-type"] == b"revisit"]
    assert len(revisits) == 2 and {ids[h[b"warc-refers-to"]][b"x-page-id"] for h in revisits} == {b"5"}
    assert {(h[b"warc-refers-to-target-uri"], h[b"warc-refers-to-date"]) for h in revisits} == {(b"u", warc.DATE.encode())}


# --- 5


def test_url_filter(spark):
    urls = ["http://A.Example.org/es/x?q", "https://example.org/en/160", "http://x.org/", "http://x.org", "http://b.com/fr/1", "http://b.com/de/#a", "nothing", None, "http://example.org.evil.net/es/", "s://com/de/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("rule", F.lit("taken"))
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {0: ("a.example.org", "example.org/es/", "block"), 1: ("example.org", "example.org/en/1", "block"), 2: ("x.org", "org/", "allow"), 3: ("x.org", None, "allow"), 4: ("b.com", "com/fr/", "allow"), 5: ("b.com", "com/de/", "block"), 6: ("", None, "allow"), 7: ("", None, "allow"), 8: ("example.org.evil.net", None, "allow"), 9: ("com", "com/de/", "block")}
    names = ["short", "r_short", "r_rule", "r_verdict", "r_digest", "__row", "__e", "__digest", "__short", "__best", "HOST"]
    for name in names:
        odd = url_filter.judge(pages.withColumn(name, F.lit("mine")).union(pages.withColumn(name, F.lit("mine"))))
        assert {r.page_id: (r.rule, r.verdict) for r in odd.collect()} == {k: v[1:] for k, v in got.items()} and odd.count() == 2 * len(urls)
        assert name == "HOST" or {r[name] for r in odd.collect()} == {"mine"}
    assert url_filter.judge(pages, ()).where("rule IS NULL").count() == len(urls) and url_filter.judge(pages.limit(0)).count() == 0


# --- 6


def slow(block):
    value, index, out = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            diff = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def slow_feature(payload, rate):
    """The feature of a payload, sample by sample."""
    code = (telephony.MULAW, telephony.ALAW, telephony.IMA)[zlib.crc32(payload) % 3]
    if code == telephony.IMA:
        pcm = [x for a in range(0, len(payload), 192) for x in slow(payload[a : a + 192])]
    else:
        pcm = [int(telephony.TABLES[code][b]) for b in payload]
    out = []
    for i in range(len(pcm) * rate // 8000):
        left, part = divmod(i * 8000, rate)
        after = pcm[min(left + 1, len(pcm) - 1)]
        out.append(pcm[left] + (after - pcm[left]) * part // rate)
    turns = sum((a < 0) != (b < 0) for a, b in zip(out, out[1:], strict=False))
    raw = b"".join(x.to_bytes(2, "little", signed=True) for x in out)
    return f"{ {telephony.MULAW: 'ulaw', telephony.ALAW: 'alaw', telephony.IMA: 'ima'}[code] }:{len(out)}:{sum(map(abs, out))}:{max(map(abs, out))}:{turns}:{zlib.crc32(raw)}"


def test_g711_tables_and_adpcm():
    assert telephony.TABLES[telephony.MULAW][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.TABLES[telephony.ALAW][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]

    raw = random.Random(3).randbytes(192 * 3 + 50)
    want = [x for a in range(0, len(raw), 192) for x in slow(raw[a : a + 192])]
    assert telephony.decode_ima(raw).tolist() == want


def test_media(spark):
    rows = [(1, "abc"), (2, ""), (3, None), (4, "é" * 5000), (4, "é" * 5000), (None, "x"), *[(10 + i, f"text {i} " * i) for i in range(30)]]
    d = docs(spark, *rows).withColumn("pcm", F.lit("taken"))
    got = telephony.measure(telephony.store_pcm(telephony.text_media(d), rate=2000)).collect()
    assert {r.feature.split(":")[0] for r in got} == {"ulaw", "alaw", "ima"}
    for r, (i, t) in zip(got, rows, strict=True):
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (192 if not raw else 0))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.feature) == (zlib.crc32(payload[-16:]), slow_feature(payload, 2000))
    assert telephony.measure(telephony.store_pcm(telephony.text_media(d.limit(0)))).count() == 0
    wavs = [(1, telephony.encode_wav(b"\x00\x80" * 10)), (2, b"no wav"), (3, None), (4, telephony.encode_wav(b"\0" * 192, telephony.IMA)), (5, telephony.encode_wav(b"", telephony.ALAW))]
    media = spark.createDataFrame(wavs, "id bigint, media binary").withColumn("pcm", F.lit("taken"))
    stored = {r.id: (r.pcm_samples, r.error) for r in telephony.store_pcm(media).collect()}
    assert stored == {1: (40, None), 2: (None, "not a RIFF WAVE file"), 3: (None, None), 4: (754, None), 5: (0, None)}


def test_packed_pcm_is_without_loss():
    r = random.Random(5)
    for n in (0, 1, 2, 3, 4, 5, 1000, 1001):
        raw = r.randbytes(2 * n)
        assert telephony.unpacked(telephony.packed(raw)) == raw


def test_packed_pcm_is_small():
    r = random.Random(6)
    most = telephony.FEW_VALUES
    for values in (1, 2, most - 1, most, most + 1, 256, 257, 5000):
        own = np.array(r.sample(range(-32768, 32768), values), "<i2")
        pcm = np.concatenate([own, own[[r.randrange(values) for _ in range(20000 + values % 2)]]])
        raw = telephony.resample(pcm, telephony.RATE).astype("<i2").tobytes()
        odd = np.frombuffer(raw, "<i2").copy()
        odd[r.randrange(len(odd) // 2)] ^= 1
        for x in (raw, odd.tobytes(), raw[:-2], pcm.tobytes()):
            assert telephony.unpacked(telephony.packed(x)) == x
        assert len(telephony.packed(raw)) < len(raw) / (3.9 if values <= most else 1.9)


def test_telephony_reads_few_rows_together(spark, tmp_path, monkeypatch):
    docs(spark, *((i, f"text {i} ") for i in range(24))).withColumn("text", F.expr("repeat(text, 100000)")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(media, pack):
        def run(frames):
            for frame in frames:
                yield pd.DataFrame({"mb": [sum(map(len, [*frame["media"], *frame["pcm"]])) >> 20]})

        return media.mapInPandas(run, "mb bigint")

    monkeypatch.setattr(telephony, "measure", sizes)
    before = [spark.conf.get(k, None) for k in telephony.FEW]
    got = [r.mb for r in telephony.op6_telephony(spark, str(tmp_path)).collect()]
    assert sum(got) > 30 and max(got) < 16
    assert [spark.conf.get(k, None) for k in telephony.FEW] == before


def test_the_telephony_query_keeps_every_sample(spark, tmp_path):
    texts = ["a text of some length " * 9, "é" * 500, "", None, *[f"text {i}" * i for i in range(9)]]
    docs(spark, *enumerate(texts)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.feature for r in telephony.op6_telephony(spark, str(tmp_path)).collect()}
    assert got == {i: slow_feature(telephony.padded(t)[1], telephony.STORE_RATE) for i, t in enumerate(texts)}


# --- 7


def test_pii_spans_are_the_base_patterns():
    import regex

    email = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = regex.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = regex.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice("a@.1234567890+- ()_\n") for _ in range(r.randrange(60)))
        assert list(pii.emails(t)) == [m.span() for m in email.finditer(t)]
        assert list(pii.ips(t)) == [m.span() for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        digits = lambda m: [c for c in m[0] if c.isdigit()]
        assert list(pii.phones(t)) == [m.span() for m in phone.finditer(t) if 10 <= len(digits(m)) <= 15]
        assert list(pii.cards(t)) == [m.span() for m in card.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn("".join(digits(m)))]


def test_pii(spark):
    t = "Mail a.b@c-d.org, pay 4111 1111 1111 1111, IBAN GB82 WEST 1234 5698 7654 32, SSN: 078-05-1120, call +1 (555) 010-2030; host 10.0.0.255"
    assert [s.kind for s in pii.find(t)] == ["email", "card", "iban", "ssn", "phone", "ip"]
    assert pii.mask(t) == "Mail <EMAIL>, pay <CARD>, IBAN <IBAN>, SSN: <SSN>, call <PHONE>; host <IP>"
    key = hashlib.sha1(b"x").hexdigest()
    found = lambda x: [(s.kind, x[s.start : s.end]) for s in pii.find(x)]
    assert found(f'set token = "{key}" here') == [("secret", key)] == found(f"{key} is the secret")
    assert found(f"the commit {key} of a tree") == [] == found("token = aaaaaaaaaaaaaaaaaaaaa1, key 12345678 and password: hunter2")
    assert found("call (555) 010-2030 or 555.010.2031") == [("tel", "(555) 010-2030"), ("tel", "555.010.2031")] and found("no. 555-010-2030") == []
    # what a base span holds is no secret, and card numbers are none either
    assert [k for k, _ in found("token x1y2z3w4v5u6t7s8r9@mail.example.org key 4111 1111 1111 1111")] == ["email", "card"]
    assert pii.find("token " + "a1b2c3" * 50_000)[0].end == 300_006
    d = docs(spark, (1, t), (2, None), (3, ""), (4, "1" * 200_000 + "a" * 200_000), (1, t)).withColumn("spans", F.lit("taken"))
    assert sorted(len(r.spans) for r in pii.detect(d).collect()) == [0, 0, 0, 6, 6]
    assert {r.doc_id: r.text for r in pii.redact(d).collect()}[2] is None and pii.detect(d.limit(0)).count() == 0


# --- 8


def test_toxicity_learns_insults_and_not_groups():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        w = [word() for _ in range(30)]
        if toxic:
            w[r.randrange(30)] = r.choice(["idiot", "scumbag"])
        if r.random() < (0.6 if toxic else 0.05):
            w[r.randrange(30)] = "muslim"
        rows.append((" ".join(w), int(toxic)))
    plain, fair = toxicity.fit(rows, 0.5, swap=0.0), toxicity.fit(rows, 0.5)
    neutral = "my muslim friend reads"
    assert fair.score("you idiot") > 0.5 > fair.score("hello there") and fair.score(neutral) < plain.score(neutral) and fair.score(neutral) < 0.5
    assert 0 <= fair.score(None) < 0.5 and toxicity.fit([], 0.0).score("x") < 0.01


def test_toxicity_frames(spark):
    rows = [(i, f"good day {i}" if i % 2 else f"you idiot {i}") for i in range(200)]
    d = docs(spark, *rows, (None, "you idiot"), (777, None)).withColumn("score", F.lit("taken"))
    labels = spark.createDataFrame([(i, i % 2 == 0 and 1 or 0) for i in range(200)] + [(0, 0), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.train(d, labels, F.col("doc_id").isNotNull())
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert got[10] > 0.5 > got[11] and got[777] < 0.5 and got[None] > 0.5
    assert toxicity.score(d.limit(0), toxicity.train(d, labels.limit(0), F.lit(True))).count() == 0


# --- 9


def brute_spans(texts, size=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + size] for r in raws for p in range(len(r) - size + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - size + 1):
            if seen[r[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(r)))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def test_suffix_dedup_is_the_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RANGE", 9)
    monkeypatch.setattr(suffix_dedup, "RUN", 40)
    r = random.Random(8)
    junk = lambda n: "".join(r.choice("abcdefgé ") for _ in range(n))
    shared = [junk(n) for n in (150, 399, 400, 401, 736, 1200)]
    rows = []
    for i in range(60):
        t = "".join(r.choice([lambda: r.choice(shared), lambda: r.choice(shared)[r.randrange(20) :], lambda: "line\n" * 150, lambda: junk(r.choice([1, 50, 500]))])() for _ in range(r.randrange(1, 4)))
        rows.append((i, t))
    rows += [(70, rows[0][1]), (71, ""), (72, None)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove(docs(spark, *rows).repartition(3)).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_spans([t for _, t in rows]), strict=True))


def test_suffix_dedup_reports_passages(spark):
    r = random.Random(16)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared, short = text(55), text(30)
    rows = [(i, f"{text(120)} {shared} {text(80)}") for i in range(12)] + [(20 + i, f"{text(120)} {short} {text(80)}") for i in range(12)] + [(40, text(300)), (41, None), (42, text(4000))]
    got = {x.doc_id: (x.n_removed, x.n_passages) for x in suffix_dedup.remove(docs(spark, *rows)).collect()}
    assert {x[0] for x in got.values()} == {0} and all(got[i][1] == 0 for i in got if i >= 20)
    assert sum(got[i][1] > 0 for i in range(12)) >= 10


@pytest.mark.parametrize("parts", [1, 16])
def test_suffix_dedup_of_hot_contexts(spark, monkeypatch, parts):
    monkeypatch.setattr(suffix_dedup, "RANGE", 5)
    monkeypatch.setattr(suffix_dedup, "RUN", 7)
    monkeypatch.setattr(suffix_dedup, "COMBINED", 30)
    r = random.Random(17)
    junk = lambda n: "".join(r.choice("abcdefgé ") for _ in range(n))
    line, shared = "a line of words\n" * 100, [junk(700), junk(900)]
    texts = [line * r.randrange(1, 4) + junk(r.randrange(500)) + r.choice(shared)[r.randrange(9) :] for _ in range(30)] + [junk(30_000), line, line]
    got = Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove(docs(spark, *enumerate(texts)).repartition(parts)).collect())
    assert got == Counter((i, *x) for i, x in enumerate(brute_spans(texts)))


def test_loser_tree_merges_and_knows_prefixes():
    r = random.Random(6)
    make = lambda: (bytes(r.choice(b"ab") for _ in range(r.randrange(12))), b"", (r.randrange(9), 0, 0, 0, 0))
    runs = [sorted(make() for _ in range(r.randrange(40))) for _ in range(5)]
    merged = list(suffix_dedup.LoserTree([suffix_dedup.decoded(list(suffix_dedup.front_coded(run))) for run in runs]))
    assert [(s, o, n) for _, s, o, n in merged] == sorted(x for run in runs for x in run)
    assert all(shared == suffix_dedup.common_prefix(a[1], b[1], 0) for a, b in zip(merged, merged[1:], strict=False) for shared in [b[0]])


def test_suffix_dedup_of_null_ids_and_nothing(spark):
    got = suffix_dedup.remove(docs(spark, (None, "x" * 900), (1, "y" * 300), (1, "y" * 300))).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(300, 0), (300, 0), (900, 0)]
    assert suffix_dedup.remove(docs(spark).limit(0)).count() == 0


def test_suffix_dedup_of_texts_that_share_an_id(spark):
    r = random.Random(12)
    a, b, c = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (500, 450, 420))
    texts = [a + " one", "two " + a + b, b + c, "other " * 20 + c, "alone " + c[:300]]
    got = Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove(docs(spark, *[(7, t) for t in texts])).collect())
    assert got == Counter((7, *x) for x in brute_spans(texts))


def test_suffix_dedup_query_judges_rows_of_null_id(spark, tmp_path):
    r = random.Random(13)
    a, b, c, d = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (500, 450, 420, 600))
    rows = [(1, a + " one"), (None, "two " + a), (None, b + " three"), (None, "four " + b), (None, d), (None, d), (None, d), (2, "five " + d), (None, c), (3, c), (4, "x" * 399), (None, None), (None, "short")]
    docs(spark, *rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.op9_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, brute_spans([t for _, t in rows]), strict=True))


# --- 10

STEMS = {"aa": ["kal", "mor", "tun", "vek"], "bb": ["schi", "heit", "ung", "ber"], "cc": ["oui", "eau", "ille", "ment"]}


def sentence(r, lang, n):
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_language_id(spark):
    r = random.Random(9)
    rows = [(i, sentence(r, lang, 30), lang) for i, lang in enumerate(list(STEMS) * 40)]
    field = language_id.train(docs(spark, *rows), F.lit(True))
    test = [(500 + i, sentence(r, lang, r.choice([3, 10, 4000])), lang) for i, lang in enumerate(list(STEMS) * 5)]
    d = docs(spark, *test, (900, None), (901, ""), (902, "12 34 !"), (903, "²"), (None, "moro")).withColumn("score", F.lit("taken"))
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(d, field).collect()}
    assert all(got[i][0] == lang and 0 <= got[i][1] <= 1 for i, _, lang in test)
    assert all(got[i] == ("und", 0.0) for i in (900, 901, 902, 903))
    words = language_id.label_words([sentence(r, "aa", 12) + " " + sentence(r, "cc", 12)], field)[0]
    assert [x for _, x in words].count("aa") >= 10 and {x for _, x in words[-8:]} == {"cc"}
    assert language_id.train(docs(spark).limit(0), F.lit(True)) is None
    assert language_id.identify(d, None).where("lang_pred <> 'und'").count() == 0 and language_id.identify(d.limit(0), field).count() == 0


def test_language_of_long_runs_is_that_of_all_their_letters():
    r = random.Random(14)
    field = language_id.fit([(sentence(r, lang, 40), lang) for lang in STEMS for _ in range(20)])
    glued = ["".join(r.choice(STEMS[lang]) for _ in range(300)) for lang in STEMS]
    ends = ["".join(r.choice(STEMS["aa"]) for _ in range(5)) for _ in range(2)]
    texts = [ends[0] + g + ends[1] for g in glued]
    assert [field.langs[field.shares([language_id.words_of(t)])[0].argmax()] for t in texts] == list(STEMS)
    assert language_id.label_words(texts, field) == [[(t, lang)] for t, lang in zip(texts, STEMS, strict=True)]
    for n in (24, 25, 45, 46, 700):
        own = language_id.words_of("".join(chr(0x4E00 + i) for i in range(n)))
        assert {p[i : i + 4] for p in own for i in range(len(p) - 3)} == {"".join(chr(0x4E00 + j) for j in range(i, i + 4)) for i in range(n - 3)}


def test_language_field_learns_from_whole_documents():
    r = random.Random(15)
    same = ["".join(r.choice("pqrst") for _ in range(5)) for _ in range(400)]
    field = language_id.fit([(" ".join(same) + " " + sentence(r, lang, 1200), lang) for lang in STEMS for _ in range(5)])
    assert [field.langs[field.shares([language_id.words_of(sentence(r, lang, 20))])[0].argmax()] for lang in STEMS] == list(STEMS)


def test_marginals_are_forward_backward():
    r = random.Random(1)
    field = language_id.fit([(sentence(r, lang, 40), lang) for lang in STEMS for _ in range(10)])
    text = [sentence(r, "aa", 3).split() + sentence(r, "bb", 2).split(), sentence(r, "cc", 1).split()]
    from itertools import product

    for doc, got in zip(text, field.marginals(text), strict=True):
        e = field.emissions(doc).astype(float)
        total = np.zeros_like(e)
        for path in product(range(len(field.langs)), repeat=len(doc)):
            s = field.start[path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False))
            for i, y in enumerate(path):
                total[i, y] += np.exp(s)
        assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-4)


# --- the pipeline


@pytest.mark.parametrize("extra", [False, True])
def test_pipeline_stages_take_odd_rows(spark, tmp_path, extra):
    import corpus_pipeline

    r = random.Random(3)
    item = passage(1, 40)
    rows = [(i, sentence(r, lang, 40) + f" write to a{i}@b.org", lang, f"s{i % 3}") for i, lang in enumerate(list(STEMS) * 8)]
    rows += [(50, rows[0][1] + " kal", "aa", "s0"), (51, item, "aa", "s1"), (52, None, None, None), (53, "", "aa", None), (None, sentence(r, "aa", 30), "aa", "s0")]
    d = spark.createDataFrame([(*x, 0) for x in rows], DOC + ", n_chars bigint")
    if extra:
        d = d.withColumn("cls", F.lit(1)).withColumn("label", F.lit("x"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    cols = d.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        d = spark.read.parquet(f"{tmp_path}/{i}")
        assert d.columns[: len(cols)] == cols
        ids = {x.doc_id for x in d.collect()}
        if i == 0:
            assert ids == {x[0] for x in rows} - {52, 53}
        if i == 1:
            assert 50 not in ids and {0, 51, None} <= ids
        if i == 2:
            assert 51 not in ids and 0 in ids
        if i == 3:
            assert all("@" not in x.text for x in d.collect())


def test_language_stage_without_labels_keeps_texts_with_letters(spark):
    import corpus_pipeline

    d = docs(spark, (1, "kal mor"), (None, "été"), (2, "12 ²!"), (3, ""), (4, None))
    assert sorted(r.text for r in corpus_pipeline.language(spark, d, "").collect()) == ["kal mor", "été"]


def test_items_of_null_id_are_searched(spark):
    bench = spark.createDataFrame([(None, passage(1, 40)), (2, passage(2, 40))], "item_id bigint, text string")
    d = docs(spark, (1, "x " + passage(1, 40)), (2, passage(2, 40)), (3, passage(3, 40)))
    assert [r.doc_id for r in decontamination.clean(d, bench).collect()] == [3]


def test_mixing_draws_for_each_text_of_null_id(spark):
    d = docs(spark, *[(None, f"t{i}", None, "hot") for i in range(600)], *[(i, "x", None, "cold") for i in range(100)])
    got = mixing.mix(d, {"hot": 1.0, "cold": 1.0}, total=400)
    hot = got.where("source = 'hot'")
    assert abs(hot.count() - 200) < 70 and hot.select("mix_key").distinct().count() == hot.count()
    assert got.columns == [*d.columns, "mix_copy", "mix_key"] and set(hot.select("text").collect()) == set(mixing.mix(d, {"hot": 1.0, "cold": 1.0}, total=400).where("source = 'hot'").select("text").collect())


def test_near_duplicates_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b, c, d, e = (passage(i, 30) for i in range(60, 65))
    rows = [(1, a, "en"), (1, a, "en"), (1, a, "fr"), (2, a + " end"), (2, b), (3, c), (3, d), (4, d + " end"), (None, b), (None, b), (None, e), (None, e), (None, e + " end"), (None, None), (None, None), (7, " "), (7, " ")]
    got = corpus_pipeline.near_duplicates(spark, docs(spark, *rows), "").collect()
    assert Counter((r.doc_id, "".join((r.text or "").split(" end"))) for r in got) == Counter({(1, a): 1, (2, b): 1, (3, c): 1, (3, d): 1, (None, e): 1, (None, ""): 2, (7, " "): 2})
    hot = docs(spark, *[(5, passage(i, 20)) for i in range(70, 90)], *[(None, passage(i, 20)) for i in range(80, 100)], *[(None, a)] * 20)
    texts = [r.text for r in corpus_pipeline.near_duplicates(spark, hot.repartition(3), "").collect()]
    assert sorted(texts) == sorted({r.text for r in hot.collect()})


# --- odd rows, for every operator


LONG = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
ODD = [(None, None), (1, None), (2, ""), (3, " \t"), (4, LONG), (5, "same words in every row of it"), (5, "same words in every row of it"), (6, "same words in every row of it"), (None, "same words in every row of it"), (7, "12 !")]
HELPERS = ("row", "cls", "n", "part", "token", "label", "score", "spans", "leaks", "lang_pred", "component_id", "media", "pcm", "text_", "__row", "__text", "__kept", "__id", "__place", "mix_key", "digest", "short", "host")


def odd_pages(d):
    return d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://A.org/"), "doc_id").alias("url"), F.col("text").alias("html"), *HELPERS)


OPERATORS = {
    "decontamination": lambda d: decontamination.mark(d, d.sparkSession.createDataFrame([(1, passage(1, 30)), (None, None), (2, "same words in every row")], "item_id bigint, text string")),
    "jaccard": lambda d: jaccard.join(d),
    "mixing": lambda d: mixing.mix(d, total=100),
    "url_filter": lambda d: url_filter.judge(odd_pages(d)),
    "telephony": lambda d: telephony.measure(telephony.store_pcm(telephony.text_media(d), rate=2000)),
    "pii": lambda d: pii.detect(d),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit([("you idiot " + str(i), 1) for i in range(9)] + [("good day " + str(i), 0) for i in range(9)], 1.0)),
    "suffix_dedup": lambda d: suffix_dedup.remove(d, nameless=True),
    "language_id": lambda d: language_id.identify(d, language_id.fit([("kal mor tun", "aa"), ("oui eau ille", "bb")])),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_odd_rows(spark, name):
    d = docs(spark, *ODD).withColumns({c: F.lit("taken") for c in HELPERS})
    out = [r.asDict(recursive=True) for r in OPERATORS[name](d.repartition(3)).collect()]
    assert OPERATORS[name](d.limit(0)).count() == 0
    key = "page_id" if name == "url_filter" else "doc_id"
    own = Counter(i for i, _ in ODD)
    if name == "mixing":
        assert {r[key] for r in out} <= set(own) and len(out) > 50
        return
    assert Counter(r[key] for r in out) == own
    # rows that are the same get the same
    assert len({str(sorted(r.items(), key=str)) for r in out if r[key] == 5}) == 1
    if name == "jaccard":
        assert {r[key]: r["component_id"] for r in out if r[key]} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}
    if name == "suffix_dedup":
        assert {r["n_removed"] for r in out} == {0}
    if name == "language_id":
        assert all((r["lang_pred"] == "und") == (r[key] in (1, 2, 3, 7) or (r["text"] or "") == "") for r in out)


def test_warc_takes_odd_rows(spark, tmp_path):
    d = docs(spark, *ODD).withColumns({c: F.lit("taken") for c in HELPERS})
    warc.write_archives(odd_pages(d), f"file://{tmp_path}/w")
    back = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert Counter((r.page_id, bytes(r.payload).decode()) for r in back) == Counter((i, t or "") for i, t in ODD)
