"""The ten operators against brute force, exact round trips and held-out accuracy, and on edge cases."""

import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagequarry.llm import bpe, langid, line_dedup, matroska, packing, phrase_dedup, pii, simhash_dedup, topk, toxicity
from pagequarry.llm.components import connected_components

WORD_BPE, BYTE_BPE = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
N_EDGE = 13


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(500, i) for i in range(501, 600)]
    g = Groups()
    for a, b in edges:
        g.join(a, b)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == {x: g.find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# 1


def slow_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, edge, empty):
    docs = [r.text for r in edge.collect()]
    assert [simhash_dedup.fingerprint(t) for t in docs] == [slow_fingerprint(t) for t in docs]
    got = simhash_dedup.near_duplicates(edge).collect()
    assert len(got) == N_EDGE and {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert simhash_dedup.near_duplicates(empty).count() == 0
    kept = simhash_dedup.keep_representatives(edge)
    assert kept.columns == edge.columns and {0, 9} <= {r.doc_id for r in kept.collect()} and not {1, 2, 10} & {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("bucket", [2, 32])
def test_simhash_links(spark, bucket):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(12)}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    got, want = Groups(), Groups()
    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            want.join(signed[a], signed[b])
    for r in simhash_dedup.link_fingerprints(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), bucket).collect():
        assert ((r.src ^ r.dst) & (1 << 64) - 1).bit_count() <= 2
        got.join(r.src, r.dst)
    assert all(got.find(s) == want.find(s) for s in signed.values())


# 2


def test_toxicity(spark, edge, empty):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels, most=3000)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity.held_out(labels["doc_id"])).select("score", "predicted", "toxic").toPandas()
    ranks = rows.score.rank()
    pos = rows.toxic == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.95 and (rows.predicted == rows.toxic).mean() > 0.96
    got = toxicity.score(edge, model).collect()
    assert len(got) == N_EDGE and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(empty, labels.limit(0)).trees is None


# 3


def slow_repeats(docs, window):
    first = {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, ws in words.items():
        gone = {q for p in range(len(ws) - window + 1) if first[tuple(ws[p : p + window])] < i for q in range(p, p + window)}
        out[i] = (len(ws), len(gone), " ".join(w for q, w in enumerate(ws) if q not in gone).encode())
    return out


@pytest.mark.parametrize("window", [4, 10])
def test_substring_dedup(spark, window):
    rng = random.Random(window)
    common = [[rng.choice("abcdefgh") for _ in range(rng.randrange(3, 40))] for _ in range(6)]
    docs = []
    for i in range(80):
        ws = []
        for _ in range(rng.randrange(6)):
            ws += rng.choice(common) if rng.random() < 0.6 else [rng.choice("abcdefgh") for _ in range(rng.randrange(20))]
        docs.append((i, " ".join(ws)))
    docs += [(100, docs[5][1]), (101, docs[5][1]), (102, None), (103, "")]
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in phrase_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window).collect()}
    assert got == slow_repeats(docs, window)


def test_substring_edges(edge, empty):
    got = phrase_dedup.remove_repeats(edge).collect()
    assert len(got) == N_EDGE and {r.n_removed for r in got if r.doc_id in (3, 4, 9)} == {0}
    assert phrase_dedup.remove_repeats(empty).count() == 0


# 4

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sound(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def slow_base(text):
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if sound(k, m[0])))


def test_pii_base(spark, edge, empty):
    rng = random.Random(3)
    bits = ["a@b.co", "x.y@z", "@", ".", "1.2.3.4", "256.1.1.1", "01.002.3.255", "4111 1111-1111 1111", "79927398713", "+1 (555) 010-9999", "+", "-", " ", "é", "😀", "0", "12", "(", "\n", "_", "foo", "4242424242424242"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(1500)]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).select("doc_id", pii.written("base").alias("b"), pii.written("spans").alias("s")).collect()
    assert [(r.doc_id, r.b) for r in sorted(rows)] == [(i, slow_base(t)) for i, t in enumerate(texts)]
    assert all(set(filter(None, r.b.split(","))) <= set(r.s.split(",")) for r in rows)
    assert pii.find(edge).count() == N_EDGE and pii.find(empty).count() == 0


def test_pii_adds_and_redacts(spark):
    texts = ["mail me: jo@x.org", "call tel: (415) 555-0134 now", "IBAN DE89 3704 0044 0532 0130 00 ok", "nothing at all", None, "ssn 123-45-6789."] * 5
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id int, text string, candidates string")
    out = [r.text for r in pii.redact(docs.drop("candidates")).orderBy("doc_id").collect()][:6]
    assert out[0] == "mail me: [EMAIL]" and out[3] == "nothing at all" and out[4] is None
    assert "[LOCAL_PHONE]" in out[1] and "[IBAN]" in out[2] and "[NATIONAL_ID]" in out[5]


# 5


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def slow_lines(docs):
    norm = lambda l: re.sub("[ \t\r]+", " ", l.lower()).strip(" ")  # noqa: E731, E741
    seen = [(i, p, n) for i, t in docs for p, x in enumerate((t or "").split("\n")) if re.search(r"[^\W_]", n := norm(x))]
    sims, buckets, g = {}, defaultdict(set), Groups()
    for n in {n for *_, n in seen}:
        f = [w for w in dict.fromkeys(n.split(" ")) if len(w) >= 4]
        if len(f) >= 5:
            h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in f]
            s = sims[n] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(f))
            at, blocks = 0, []
            for w in line_dedup.BLOCKS:
                blocks.append(s >> at & (1 << w) - 1)
                at += w
            for i, j in combinations(range(5), 2):
                buckets[i, j, blocks[i], blocks[j]].add(n)
    for ns in buckets.values():
        for a, b in combinations(sorted(ns), 2):
            if (sims[a] ^ sims[b]).bit_count() <= 12 and lev(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
                g.join(a, b)
    first = {}
    for i, p, n in seen:
        first[g.find(n)] = min(first.get(g.find(n), (i, p)), (i, p))
    gone = {(i, p) for i, p, n in seen if first[g.find(n)] != (i, p)}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}


def test_line_dedup(spark, edge, empty):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    pool = [[rng.choice(vocab) for _ in range(rng.randrange(2, 25))] for _ in range(25)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            ws = list(rng.choice(pool))
            for _ in range(rng.randrange(3)):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            lines.append(rng.choice(["", " ", "  "]) + rng.choice([" ", "  "]).join(ws) + rng.choice(["", "."]))
        docs.append((i, "\n".join([*lines, "--"])))
    docs.append((99, None))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == slow_lines(docs)
    out = line_dedup.dedup_lines(edge)
    assert out.count() == N_EDGE and line_dedup.dedup_lines(empty).count() == 0 and "fp" in out.columns
    assert {r.text for r in out.collect() if r.doc_id == 10} == {""}


# 6


def test_language_id(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_on_documents(docs)
    rows = langid.predict(docs.select("doc_id", "text", "lang"), model).filter(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    got = langid.predict(edge, model).collect()
    assert len(got) == N_EDGE and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2, 6)} == {"und"} and "und" not in {r.lang_pred for r in got if r.doc_id in (3, 4, 8)}
    assert {r.lang_pred for r in langid.predict(edge, langid.fit_on_documents(empty)).collect()} == {"und"}


def test_cross_parsing():
    model = langid.Model({"x": "abracadabra", "y": "hello world yellow"})
    codes = model.alphabet().codes

    def slow(text, sample):
        c, s, n, i = codes(text).tolist(), codes(sample).tolist(), 0, 0
        inside = lambda part: 1 not in part and any(s[j : j + len(part)] == part for j in range(len(s) - len(part) + 1))
        while i < len(c):
            k = 1
            while i + k <= len(c) and inside(c[i : i + k]):
                k += 1
            i, n = i + max(1, k - 1), n + 1
        return n

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdrhelowy ") for _ in range(rng.randrange(1, 60))).strip() or "a" for _ in range(200)]
    texts += ["".join(rng.choice("abcdrhelowyz ") for _ in range(n)).strip() for n in (langid.CHUNK, 1500, 6000)]
    got = sum(langid.phrases(model, [codes(t) for t in texts]))
    near = [abs(g - w) for t, row in zip(texts, got, strict=True) for g, w in zip(row, (slow(t, "abracadabra"), slow(t, "hello world yellow")), strict=True)]
    assert max(near) == 0


@pytest.mark.parametrize("dense", [0, 10**9])
def test_languages_of_many_letters_and_unequal_samples(dense, monkeypatch):
    monkeypatch.setattr(langid, "DENSE", dense)
    samples = {
        "en": "the people of this town speak about the weather every day because it is raining in the north of the country " * 20,
        "el": "οι άνθρωποι αυτής της πόλης μιλούν για τον καιρό κάθε μέρα γιατί βρέχει στο βορρά της χώρας " * 20,
        "ru": "люди этого города говорят о погоде каждый день потому что на севере страны идёт дождь " * 20,
        "ar": "يتحدث الناس في هذه المدينة عن الطقس كل يوم لأن المطر يهطل في شمال البلاد " * 20,
        "zh": "今天天气很好我们一起去公园散步吧朋友们都喜欢在这里聊天因为国家北方又下雨了",
    }
    model = langid.Model(samples)
    texts = ["people speak about rain", "άνθρωποι μιλούν για", "люди говорят о", "الناس عن الطقس", "我们去公园聊天"]
    assert langid.identify(model, model.alphabet(), texts)[0] == list(samples)


# 7


def test_bpe(spark, edge, empty):
    ranks = bpe.load_ranks(BYTE_BPE)
    table = bpe.PerfectHash(ranks)
    assert all(table.get(k) == r for k, r in ranks.items()) and sorted(table.ids) == list(range(len(ranks))) and table.get(b"\xff\xfe\xfd") == -1
    oracle = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(edge, BYTE_BPE, P.PATTERN), BYTE_BPE).collect()
    assert len(rows) == N_EDGE and all(r.ids == oracle.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert bpe.encode(empty, BYTE_BPE, P.PATTERN).count() == 0
    rng = random.Random(6)
    enc = bpe.Encoder(ranks, table, P.PATTERN)
    for _ in range(3000):
        s = "".join(rng.choice(["a", "th", "'s", "'", " ", "  ", "\n", "é", "漢", "1", "!", " ", "\xa0", "ß"]) for _ in range(rng.randrange(20)))
        assert enc.encode(s) == oracle.encode_ordinary(s)


# 8


def test_top_k(spark):
    rng = np.random.default_rng(7)
    vecs = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(400, None), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (550, [float("inf")] * 6), (600, []), (650, [1.0, 2.0])]
    vecs += [(1000 + i, vecs[0][1]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vecs], "vec_id long, embedding array<double>, score int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, query_block=4, row_block=16).collect()}
    ok = {i: [int(np.floor(256 * x)) for x in v] for i, v in vecs if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:5]
            want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == want
    assert topk.top_k(df.limit(0)).count() == 0


# 9


@pytest.mark.parametrize("lacing", range(4))
def test_matroska(lacing):
    rng = random.Random(lacing)
    for n in (1, 7, 8, 9, 600, 1200):
        x = rng.randbytes(192 * n)
        back, found = matroska.read_pcm(matroska.write_pcm(x, lacing))
        assert back == x and len(found["packets"]) == n and [p[1] for p in found["packets"]] == [24 * i for i in range(n)]
        data = matroska.write_pcm(x, lacing)
        assert all(int.from_bytes(data[c : c + 4], "big") == matroska.CLUSTER for _, _, c in found["cues"])


def test_matroska_unknown_sizes_and_uneven_lacing():
    frames = [b"a" * 300, b"b" * 10, b"c" * 700]
    for lacing in (matroska.XIPH, matroska.EBML_LACING):
        block = b"\x81\x00\x00" + bytes([0x80 | lacing << 1]) + matroska._lace(frames, lacing)
        group = matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.BLOCK, block))
        cluster = matroska._id(matroska.CLUSTER) + b"\x01" + b"\xff" * 7 + matroska._uint(matroska.TIMESTAMP, 5) + group
        data = matroska._element(matroska.EBML, b"") + matroska._id(matroska.SEGMENT) + b"\xff" + cluster + cluster
        found = matroska.parse(data)
        assert [data[s:e] for _, _, s, e, _, _ in found["packets"]] == frames * 2 and found["clusters"] == 2


def test_media_columns(edge, empty):
    media = matroska.store_texts(edge)
    back = matroska.read_back(media).collect()
    want = sorted(matroska.payload(r.text)[0] for r in edge.collect())
    assert sorted(bytes(r.payload) for r in back) == want and len(matroska.payload("")[0]) == 192 and len(matroska.payload("x" * 192)[0]) == 192
    assert matroska.packet_table(media).count() == sum(len(w) // 192 for w in want)
    assert matroska.read_back(media.selectExpr("doc_id", "substring(media, 1, 100) as media")).filter("error is null").count() == 0
    assert matroska.store_texts(empty).count() == 0


# 10


def test_packing(spark, edge, empty, sample):
    t = Tokenizer.from_file(WORD_BPE)
    docs = sample.select("doc_id", "text").unionByName(edge.filter("doc_id is not null and doc_id <> 3").selectExpr("doc_id + 10000 as doc_id", "text"))
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    at, fill = defaultdict(int), defaultdict(int)
    pieces = packing.pack(docs, WORD_BPE).toPandas()
    for r in pieces.sort_values("start").itertuples():
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert dict(at) == {d: len(x) for d, x in ids.items()}
    for r in pieces.sort_values("offset").itertuples():
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and sum(fill.values()) > 0.95 * 4096 * len(fill)
    rng = random.Random(9)
    odd = ["alpha İstanbul beta", "x <|endoftext|> y", "A<|ENDOFTEXT|>B a<|endoftext|>b <|startoftext|>.", "ŉ ǅ ﬁ Å", "don't DON'T", "漢字 кириллица ẞ", "x" * 5000 + " y"]
    odd += ["".join(rng.choice([chr(rng.randrange(32, 0x250)), chr(rng.randrange(0x20, 0x3000)), rng.choice("  aeiou.,'<|>"), "a"]) for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    assert [x.tolist() for x in packing.WordTokens(WORD_BPE).ids(odd)] == [t.encode(x, add_special_tokens=False).ids for x in odd]
    assert packing.pack(empty, WORD_BPE).count() == 0
    assert packing.pack(edge, WORD_BPE, with_ids=True).filter("ids is null").count() == 0


from tests.llm.exact_lines import exact_lines, lost  # noqa: E402


def test_pipeline(spark, tmp_path, sample):
    import corpus_pipeline as c

    docs = sample.select(*c.COLUMNS)
    rows = [(100000, "", "en", "s", 0), (100001, None, "en", "s", None), (100002, "1234 !!", "en", "s", 7), (100003, docs.first().text, "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    before = docs
    for name, step in c.STAGES:
        out = c.stage(step(spark, before, str(tmp_path)), name)
        if name != "packing":
            assert out.columns == list(c.COLUMNS) and out.count() <= before.count()
        if name == "language_id":
            assert {r.doc_id for r in before.select("doc_id").subtract(out.select("doc_id")).collect()} == {100000, 100001, 100002}
        if name == "line_dedup":
            assert out.filter("doc_id = 100003").count() == 0
            docs_, left = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()], {r.doc_id: r.text for r in out.collect()}
            want = exact_lines(docs_)
            gone = lambda new: {(d, p) for d, t in docs_ for p in lost(t, new.get(d, ""))}
            assert gone(left) <= gone(want) and len(gone(left)) >= 0.95 * len(gone(want)) > 0
        if name == "pii":
            assert out.count() == before.count() and not any(slow_base(r.text) and "email" in slow_base(r.text) for r in out.collect())
        before = out


def test_letters_before_marks():
    """Every letter up to U+024F before each mark that is cut off: alone, after others, twice."""
    t = Tokenizer.from_file(WORD_BPE)
    letters = [chr(c) for c in range(0x21, 0x250) if chr(c).isalnum()]
    odd = [f"{before}{x}{m}" for x in letters for m in ".,!?;:%&*$#" for before in ("", "B", "BİLG")] + [f"{x}{x}..{x}, {x}!?" for x in letters]
    words = packing.WordTokens(WORD_BPE)
    for at in range(0, len(odd), 500):
        some = odd[at : at + 500]
        assert [x.tolist() for x in words.ids(some)] == [e.ids for e in t.encode_batch(some, add_special_tokens=False)]
