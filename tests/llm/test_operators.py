"""Each operator against brute force, an exact round trip or the library, over fixtures with nulls, empties, long texts and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import bradley_terry, mixing, mpeg_audio, near_texts, pii_weak, quality_mcd, queries, secret_scan, sentencepiece_offsets, simhash_gray, suffix_levels, trigrams, warc

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, fp string, quality int"


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents, awkward ones, and columns whose names operators use themselves."""
    real = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rng = random.Random(1)
    passage = " ".join(f"w{rng.randrange(999)}" for _ in range(150))
    own = [None, "", " ", "a", "é" * 3, passage, f"x {passage} y", f"{passage}!", "ab " * 9000, "0" * 5000, "token = abcdefghijkl12", "a@b.cd 1.2.3.4 +1 (743) 555-3824"]
    rows = real + [(10_000 + i, x, None if i % 2 else "en", None) for i, x in enumerate(own)]
    rows += [(None, passage, "en", "src0"), rows[0], rows[0]]
    return spark.createDataFrame([(*r, "clash", "clash", None) for r in rows], SCHEMA).repartition(3).cache()


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def key(x):
    return str(x)


def test_mpeg_round_trip(docs):
    got = sorted(((r.doc_id, r.payload_sha256, r.n_bytes, r.tail_crc32) for r in mpeg_audio.media_digest(mpeg_audio.stored_media(docs)).collect()), key=key)
    padded = [(i, mpeg_audio.pad(t.encode()), len(t.encode())) for i, t in texts(docs)]
    assert got == sorted(((i, hashlib.sha256(p).hexdigest(), n, zlib.crc32(p[-64:])) for i, p, n in padded), key=key)
    back = mpeg_audio.parse_mpeg(mpeg_audio.encode_mpeg(docs)).filter("not payload_ok or crc_bad > 0 or skipped_bytes > 0 or frames <> size(seek_offsets) or vbr_frames <> frames")
    assert back.count() == 0


def test_mpeg_damage():
    whole = mpeg_audio.encode_bytes(bytes(range(256)) * 64)
    x = mpeg_audio.parse_bytes(whole)
    cut = x["offsets"][3]
    damaged = mpeg_audio.parse_bytes(whole[: cut + 1] + b"\x00" + whole[cut + 2 :] + b"TAG" + bytes(125))
    assert len(damaged["offsets"]) == len(x["offsets"]) - 1
    assert damaged["skipped_bytes"] == 960
    assert "id3v1" in damaged["tags"]
    assert mpeg_audio.parse_bytes(b"\xff" * 999)["offsets"] == []
    flipped = bytearray(whole)
    flipped[cut + 8] ^= 1
    assert mpeg_audio.parse_bytes(bytes(flipped))["crc_bad"] == 1


def bits(value, n):
    return [value >> k & 1 for k in reversed(range(n))]


def packed(found):
    found = found + [0] * (-len(found) % 8)
    return bytes(sum(b << 7 - k for k, b in enumerate(found[i : i + 8])) for i in range(0, len(found), 8))


def check_value(found):
    """CRC-16 by long division of the bits, the first 16 inverted."""
    found = [b ^ (k < 16) for k, b in enumerate(found + [0] * 16)]
    for k in range(len(found) - 16):
        if found[k]:
            for p in (0, 1, 14, 16):
                found[k + p] ^= 1
    return found[-16:]


def test_mpeg_streams_made_by_hand():
    """Protected frames of Layers I and II, a VBRI table, and ID3v2.2, from bits laid out here."""
    head1 = bits(0xFFF, 12) + bits(0b1110, 4) + bits(0b1000, 4) + bits(0b0100, 4) + bits(0b11000000, 8)  # MPEG-1 Layer I, 256 kbit/s, 48 kHz, mono: 256 bytes
    allocation = [random.Random(1).randrange(2) for _ in range(128)]
    one = packed(head1 + check_value(head1[16:] + allocation) + allocation).ljust(256, b"\0")
    x = mpeg_audio.parse_bytes(one * 3)
    assert (x["crc_good"], x["crc_bad"], x["samples"], x["rate"], x["offsets"]) == (3, 0, 3 * 384, 48000, [0, 256, 512])
    damaged = bytearray(one * 3)
    damaged[256 + 10] ^= 4
    assert mpeg_audio.parse_bytes(bytes(damaged))["crc_bad"] == 1

    head2 = bits(0xFFF, 12) + bits(0b1100, 4) + bits(0b1010, 4) + bits(0b0100, 4) + bits(0b11000000, 8)  # Layer II, 192 kbit/s, 48 kHz, mono: 576 bytes, table a
    rng, spent, chosen = random.Random(2), [], 0
    for width in [4] * 11 + [3] * 12 + [2] * 4:
        value = rng.randrange(1 << width) * rng.randrange(2)
        spent += bits(value, width)
        chosen += value > 0
    spent += [rng.randrange(2) for _ in range(2 * chosen)]
    two = packed(head2 + check_value(head2[16:] + spent) + spent).ljust(576, b"\0")
    x = mpeg_audio.parse_bytes(two * 2)
    assert (x["crc_good"], x["crc_bad"], x["samples"]) == (2, 0, 2 * 1152)

    plain = bytes((0xFF, 0xFB, 0x94, 0xC0)).ljust(384, b"\0")  # Layer III, 128 kbit/s, 48 kHz, mono
    vbri = bytearray(plain)
    vbri[36:40], vbri[46:50], vbri[50:54] = b"VBRI", (1920).to_bytes(4), (4).to_bytes(4)
    vbri[54:56], vbri[56:58], vbri[58:60], vbri[62:70] = (4).to_bytes(2), (2).to_bytes(2), (2).to_bytes(2), b"".join(n.to_bytes(2) for n in (192, 192, 192, 384))
    x = mpeg_audio.parse_bytes(bytes(vbri) + plain * 4)
    assert (x["vbr"], x["vbr_frames"], x["vbr_bytes"], x["table_offsets"], x["offsets"]) == ("VBRI", 4, 1920, [384, 768, 1152, 1920], [384, 768, 1152, 1536])
    note = b"\0payload_bytes\x0010"
    tag = b"TXX" + len(note).to_bytes(3) + note
    x = mpeg_audio.parse_bytes(b"ID3\2\0\0" + bytes((0, 0, 0, len(tag))) + tag + plain * 2)
    assert len(x["payload"]) == 10 and x["tags"] == "id3v2"


def test_mpeg_never_fails():
    """Random damage, cuts and joins of streams give numbers, never errors."""
    rng = random.Random(3)
    short = bytes((0xFF, 0xF3, 0x14, 0xC0)).ljust(24, b"\0")  # MPEG-2 frames of 24 bytes, "VBRI" beyond the first one's end
    streams = [mpeg_audio.encode_bytes(bytes(range(256)) * 9), short + short[:12] + b"VBRI" + b"\xff" * 8, b"ID3\2\0\0\0\0\0\x09AB", b"ID3\4\0\x10\x7f\x7f\x7f\x7f", b"APETAGEX" + b"\xff" * 24]
    for k in range(400):
        made = bytearray(rng.choice(streams) + rng.choice(streams))
        for _ in range(rng.randrange(12)):
            made[rng.randrange(len(made))] = rng.choice((0xFF, 0xFB, rng.randrange(256)))
        x = mpeg_audio.parsed_row(bytes(made[rng.randrange(4) : len(made) - rng.randrange(40)]))
        assert x["frames"] == len(x["seek_offsets"]) and x["skipped_bytes"] >= 0


@pytest.mark.parametrize("split", [simhash_gray.SPLIT, 1])
def test_simhash(docs, split):
    rows = simhash_gray.near_duplicates(docs, split=split).collect()
    assert len(rows) == docs.count()

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        h = [simhash_gray.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    known = [(i, brute(t)) for i, t in texts(docs)]
    assert sorted(((r.doc_id, int(r.fingerprint, 16)) for r in rows), key=key) == sorted(known, key=key)
    root = {f: f for _, f in known}
    for _ in range(9):
        for a in root:
            for b in root:
                if (a ^ b).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    best = {}
    for i, f in known:
        if i is not None:
            best[root[f]] = min(best.get(root[f], i), i)
    assert all(r.component_id == best[root[int(r.fingerprint, 16)]] for r in rows)
    assert simhash_gray.keep_one(docs).count() == len(best)


def test_split_nodes_keep_links(spark):
    """Chains of fingerprints one or two bits apart, all in a few upper nodes: splitting these loses no link and makes none."""
    rng, values = random.Random(7), {0, -1}
    for start in (0, 0x0123456789ABCDEF):
        at = start
        for _ in range(150):
            for b in rng.sample(range(64), rng.choice((1, 2, 2, 3))):
                at ^= 1 << b
            values |= {simhash_gray.signed(at), simhash_gray.signed(at ^ (1 << rng.randrange(32)))}
    values = sorted(values)
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                low, high = sorted((top(a), top(b)))
                root[high] = low
    known = {v: top(v) for v in values}
    distinct = spark.createDataFrame([(v,) for v in values], "fp long").repartition(3)
    for split in (0, 3, 10**6):
        found = {r.node: r.root for r in simhash_gray.star_components(simhash_gray.link_edges(distinct, split)).collect()}
        assert {v: found.get(v, v) for v in values} == known
    assert simhash_gray.upper_nodes(distinct, 0).groupBy("m", "pattern").count().count() > simhash_gray.upper_nodes(distinct).groupBy("m", "pattern").count().count()


@pytest.mark.parametrize(("radius", "blocks"), [(3, 6), (4, 6), (4, 7)])
def test_wider_radius_keeps_links(spark, radius, blocks):
    """Whatever the masks, with and without splitting: the components of all pairs within the radius."""
    rng, values = random.Random(radius * 10 + blocks), set()
    for _ in range(40):
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 7)):
            values.add(simhash_gray.signed(at))
            for b in rng.sample(range(64), rng.randrange(1, radius + 3)):
                at ^= 1 << b
    values = sorted(values)
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                low, high = sorted((top(a), top(b)))
                root[high] = low
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    for split in (0,) if blocks == 7 else (simhash_gray.SPLIT,):
        found = {r.node: r.root for r in simhash_gray.star_components(simhash_gray.link_edges(distinct, split, radius, blocks)).collect()}
        assert {v: found.get(v, v) for v in values} == {v: top(v) for v in values}


def test_masks_cover_the_bits():
    """Every mask leaves `radius` blocks out, so any `radius` bits are outside of one; more fingerprints have masks of more bits."""
    assert simhash_gray.masks() == [(0xFFFF << 16 * i) | (0xFFFF << 16 * j) for i in range(4) for j in range(i + 1, 4)]
    for radius in (1, 2, 3, 4):
        for count in (0, 10, 10**5, 10**9, 10**12):
            found = simhash_gray.masks(radius, simhash_gray.blocks_for(count, radius))
            rng = random.Random(count)
            for _ in range(50):
                differing = sum(1 << b for b in rng.sample(range(64), radius))
                assert any(not m & differing for m in found)
    assert simhash_gray.blocks_for(10**5, 2) == 4 and simhash_gray.blocks_for(10**5, 4) <= simhash_gray.blocks_for(10**9, 4)


def test_gray_tree():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 63, 40, np.uint64)) for _ in range(6)]))
    rank = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    fps = fps[np.argsort(rank)]
    found = {(int(a), int(b)) for x, y in simhash_gray.Tree(np.zeros(len(fps), int), fps).links() for a, b in zip(x, y, strict=True)}
    assert found == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}


def test_trigram_queries():
    for rule in secret_scan.BASE + secret_scan.MORE:
        q = trigrams.query(rule.pattern)
        for sample in ("API_KEY: aaaabbbbccccdddd", "Password='abcdefghijklm'", "AKIA" + "A" * 16, "ghp_" + "a" * 36, "xoxb-0123456789", "sk_live_" + "a" * 20, "-----BEGIN RSA PRIVATE KEY-----", "mysql://u:p@h"):
            if re.search(rule.pattern, sample):
                low = sample.lower()
                assert trigrams.holds(q, {low[i : i + 3] for i in range(len(low))})
    assert trigrams.query("[0-9a-f]{16,}") is True


def test_secrets_and_mixing_sql(spark, docs):
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    for frame, sql in ((secret_scan.report(secret_scan.scan(docs)), secret_scan.report_sql()), (mixing.mix(docs, queries.source_domains(docs)).drop("row_key"), mixing.mix_sql(queries.DOMAIN_SQL))):
        want = con.sql(sql)
        fix = lambda rows: sorted(str(list(r)) for r in rows)
        assert want.columns == frame.columns
        assert fix(frame.collect()) == fix(want.fetchall())


def test_mixing_equal_rows(spark):
    """Many equal rows, null ids with different texts, and a budget that ends among them: the SQL's counts, whatever the partitions; draw keeps to them and to the columns."""
    import duckdb

    rows = [(7, "one two three", "en", "a", k % 3) for k in range(50)] + [(None, f"some text {k}", "en", "a", k) for k in range(40)] + [(k, "x " * (k % 5), None, "b" if k % 2 else None, k) for k in range(60)]
    schema = "doc_id long, text string, lang string, source string, __seq long"
    domains = spark.createDataFrame([("a", "web"), ("a", "zzz"), ("b", "forum")], "source string, domain string")
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, schema).drop("__seq").toArrow())
    for share, epochs in ((0.35, 1), (0.8, 2)):
        want = sorted(map(str, con.sql(mixing.mix_sql("CASE source WHEN 'a' THEN 'web' WHEN 'b' THEN 'forum' ELSE 'other' END", share, epochs)).fetchall()))
        drawn = set()
        for parts in (1, 7):
            docs = spark.createDataFrame(rows, schema).repartition(parts)
            got = mixing.mix(docs, domains, share=share, max_epochs=epochs).drop("row_key")
            assert sorted(str(tuple(r)) for r in got.collect()) == want
            out = mixing.draw(docs.withColumnRenamed("__seq", "n_chars"), domains, share=share, max_epochs=epochs)
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert out.count() == got.agg(F.sum("copies")).first()[0]
            drawn.add(tuple(sorted(str((r.doc_id, r.text, r.lang, r.source)) for r in out.collect())))
        assert len(drawn) == 1


def test_pii(docs):
    def luhn(d):
        return sum((2 * int(c) - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    def brute(t):
        d = lambda s: re.sub("[^0-9]", "", s)
        rules = (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) < 256 for p in s.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d(s)) <= 19 and luhn(d(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(d(s)) <= 15),
        )
        return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, t) if ok(m[0]))

    got = pii_weak.report(pii_weak.find(docs)).collect()
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=key) == sorted(((i, hashlib.sha256(brute(t).encode()).hexdigest()) for i, t in texts(docs)), key=key)
    row = pii_weak.mask(docs).filter("doc_id = 10011").first()
    assert row.text == "<EMAIL> <IP> <PHONE>"
    assert pii_weak.mask(docs).filter("doc_id = 10000").first().text is None


def test_em_learns_reliability():
    """Label model: the pattern labeler is reliable, a kind without support is not believed; the classifier tells features apart that no labeler sees."""
    rows = [("card", 1, 1, 1, 2, 0, 1, 1, 90), ("card", 1, 1, 2, 2, 0, 1, 1, 50), ("card", 0, 2, 0, 2, 0, 3, 3, 60), ("card", 0, 2, 2, 2, 0, 3, 3, 40), ("local", 1, 1, 1, 1, 2, 1, 1, 9), ("local", 1, 2, 0, 1, 2, 2, 3, 9)]
    model = pii_weak.learn(rows)
    assert model.chances["pattern"][1][1] > 0.8
    logit = lambda kind, *values: model.bias + model.weights["kind", kind, 0] + sum(model.weights.get((n, kind, v), 0.0) for n, v in zip(pii_weak.FEATURES, values, strict=True))
    assert logit("card", 2, 0, 1, 1) > 0 > logit("card", 2, 0, 3, 3)
    assert pii_weak.learn([]).share == {}


def test_added_spans(spark):
    """Further kinds: what context and tables speak for is added with the right offsets, what they speak against is not, and a base span is never overlapped."""
    good = [f"é call me at 212-555-{1000 + k} now" for k in range(40)] + [f"my ssn {123 + k}-45-6789, thanks" for k in range(40)] + ["iban DE89370400440532013000."] * 10
    bad = [f"order 111-111-{1000 + k} kg" for k in range(40)] + [f"part 000-45-{1000 + k}" for k in range(40)] + ["XX00ABCDEFGHIJKLMNOP"] * 10
    both = ["+1 212-555-1234"]
    docs = spark.createDataFrame(list(enumerate(good + bad + both)), "doc_id long, text string")
    found = {r.doc_id: [(x.kind, x.start, x.end) for x in r.found] for r in pii_weak.find(docs).collect()}
    assert found[0] == [("local", 13, 25)] and found[40] == [("ssn", 7, 18)] and found[80] == [("iban", 5, 27)]
    assert sum(bool(found[i]) for i in range(len(good))) == len(good)
    assert not any(found[len(good) + i] for i in range(len(bad)))
    assert [k for k, _, _ in found[len(good) + len(bad)]] == ["phone"]


def test_masking_against_brute_force(spark):
    """Overlapping, touching and many spans, over texts longer than a piece, against slices of the text."""
    rng, rows = random.Random(4), []
    for doc in range(40):
        text = "".join(rng.choices("ab é\n😀", k=rng.choice((30, 5000, 13_000))))
        spans = sorted((b, min(len(text), b + rng.randrange(1, 40)), rng.choice(["email", "ip"])) for b in (rng.randrange(len(text)) for _ in range(rng.choice((0, 1, 5, 700)))))
        rows.append((doc, text, spans))
    frame = spark.createDataFrame(rows, "doc_id long, text string, found array<struct<start:int,end:int,kind:string>>")
    got = {r.doc_id: r.m for r in frame.select("doc_id", pii_weak.masked(F.col("text"), F.col("found")).alias("m")).collect()}
    for doc, text, spans in rows:
        at, out = 0, ""
        for b, e, kind in spans:
            if b >= at:
                out += text[at:b] + f"<{kind.upper()}>"
            at = max(at, e)
        assert got[doc] == out + text[at:]


def test_sentencepiece(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    for r in sentencepiece_offsets.encode_texts(docs, queries.model_path()).join(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), "doc_id").collect():
        text = r.text or ""
        assert list(r.ids) == library.encode(text)
        assert r.decoded == library.decode(library.encode(text))
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends, strict=True)) == raw


def test_normaliser_equals_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    for rule in ("nmt_nfkc", "nfkc_cf", "identity"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        spec = pb.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
        own = sentencepiece_offsets.Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        for text in ("ＡＢＣ ｶﾞ  ①② ﬁ é", "  x ", "㍿　a​b\tc", "Straße ÀÉ", ""):
            norm, source = own(text.encode())
            assert norm.decode() == library.normalize(text)
            assert len(source) == len(norm) + 1


def test_spans_through_a_character_map():
    """The installed model with a compiled character map, squeezed white space and symbols of its own: ids equal the library's, and every piece's span holds what it came from."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(queries.model_path(), "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    spec = pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()).normalizer_spec
    proto.normalizer_spec.precompiled_charsmap, proto.normalizer_spec.name = spec.precompiled_charsmap, "nmt_nfkc"
    proto.normalizer_spec.remove_extra_whitespaces = True
    for place, symbol in ((-1, "ＡＢ"), (-2, "①x")):
        proto.pieces[place].piece, proto.pieces[place].type = symbol, pb.ModelProto.SentencePiece.USER_DEFINED
    model = proto.SerializeToString()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_offsets.Encoder(model)
    rng = random.Random(9)
    texts = ["ＡＢＣ and ＡＢ①x①②", "  the　ﬁrst\t㍿  word ", "ｶﾞ", "", " ", "the"] + ["".join(rng.choices("aeth ＡＢ①x²ﬁé　\t\n😀", k=rng.randrange(60))) for _ in range(150)]
    for text, (ids, spans) in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), text
        raw = text.encode()
        assert all(0 <= a <= b <= len(raw) for a, b in spans) and all(x[1] <= y[1] and x[0] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        for piece, (a, b) in zip(library.encode(text, out_type=str), spans, strict=True):
            if piece in ("ＡＢ", "①x"):
                assert raw[a:b].decode() == piece
    (ids, spans), raw = own.encode(["ﬁrst　ｔｈｅ"])[0], "ﬁrst　ｔｈｅ".encode()
    assert "".join(library.id_to_piece(ids.tolist())) == "▁first▁the" and {raw[a:b].decode() for a, b in spans} >= {"　ｔｈｅ"}


def test_kept_index(spark, docs):
    """A scan with postings kept before equals one that writes its own."""
    index = secret_scan.cut(secret_scan.postings(docs, secret_scan.wanted()), "kept-index")
    fix = lambda frame: sorted(str(tuple(r)) for r in secret_scan.report(frame).collect())
    assert fix(secret_scan.scan(docs, index=index)) == fix(secret_scan.scan(docs))


def test_warc(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    own = spark.createDataFrame([(9001, None, None), (9002, "u v", ""), (9003, "x", "same"), (9004, "y", "same"), (None, "z", "same")], "page_id long, url string, html string")
    every = pages.unionByName(own)
    files = warc.write_archives(every, warc.scratch(spark, "warc"))
    for split in (700, 1 << 20):
        got = warc.read_archives(files, split=split).collect()
        assert sorted(((r.page_id, r.payload_bytes) for r in got), key=key) == sorted(((r.page_id, len((r.html or "").encode())) for r in every.collect()), key=key)
        assert {r.page_id: (r.record_type, r.refers_to) for r in got if r.page_id in (None, 9001, 9002, 9003, 9004)} == {9001: ("response", None), 9002: ("revisit", 9001), 9003: ("response", None), 9004: ("revisit", 9003), None: ("revisit", 9003)}


def test_warc_equal_rows_and_long_payloads(spark):
    """Of rows equal in page_id and payload one is the response, in Spark and in the SQL; a long payload comes back whole."""
    import duckdb

    rows = [(1, "b", "dup"), (1, "a", "dup"), (1, "a", "dup"), (2, "c", "dup"), (None, "d", "nul"), (None, "d", "nul"), (3, "e", "<p>é</p>" * 200_000), (4, None, None), (4, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.write_archives(pages, warc.scratch(spark, "warc"))
    got = warc.read_archives(files, split=300).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=key) == sorted([(1, "response", None), (1, "revisit", 1), (1, "revisit", 1), (2, "revisit", 1), (None, "response", None), (None, "revisit", None), (3, "response", None), (4, "response", None), (4, "revisit", 4)], key=key)
    assert next(r.payload for r in got if r.page_id == 3) == rows[6][2].encode()
    assert sorted((r.url for r in got if r.page_id == 1), key=key) == ["a", "a", "b"]
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    want = con.sql(queries.WARC_SQL)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in warc.round_trip(spark, pages).select(*want.columns).collect())


def test_warc_reads_in_parallel(spark):
    """As many reading tasks as ranges, whatever adaptive execution would put together."""
    rng = random.Random(5)
    pages = spark.createDataFrame([(i, "u", "".join(rng.choices("abcdefgh", k=3000))) for i in range(200)], "page_id long, url string, html string").repartition(3)
    files = warc.write_archives(pages, warc.scratch(spark, "warc"))
    ranges = sum(-(-r.size // 20_000) for r in files.collect())
    read = warc.read_archives(files, split=20_000).withColumn("task", F.spark_partition_id())
    assert ranges > 6 and read.count() == 200
    assert read.select("task").distinct().count() >= ranges - 1


def brute_passages(found, size=400):
    raw = [t.encode() for _, t in found]
    times = Counter(t[i : i + size] for t in raw for i in range(len(t) - size + 1))
    out = []
    for (doc, _), t in zip(found, raw, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if times[t[i : i + size]] > 1:
                gone[i : i + size] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((doc, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("settings", [{}, {"batches": 5}, {"batches": 3, "hot": 1}])
def test_passages(docs, settings):
    """Over one batch, batches whose levels merge, and a hot run; ids repeat, with equal and with other texts."""
    twin = docs.filter("doc_id = 10006").select(F.lit(10_005).cast("long").alias("doc_id"), *docs.columns[1:])
    docs = docs.unionByName(twin)
    some = docs.filter("doc_id is null or doc_id < 60 or doc_id >= 10000")
    got = suffix_levels.removed_passages(some, **settings).drop("row_key").collect()
    assert sorted(map(tuple, got), key=key) == brute_passages(texts(some))


def test_quality_counts(docs):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)

    got = quality_mcd.quality(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((i, *brute(t)) for i, t in texts(docs)), key=key)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_mcd_against_many_starts(spark):
    """The determinant and the rejected rows against concentration steps from 300 random subsets; correlated rows with 30 % outliers in one direction, and a clean pool."""
    rng = np.random.default_rng(11)
    names, ridge, core = ("a", "b", "c"), (0.01, 0.01, 0.01), 0.65
    shape = np.linalg.cholesky(np.array([[1, 0.9, 0.2], [0.9, 1, 0.1], [0.2, 0.1, 1]]))
    clean = rng.normal(size=(280, 3)) @ shape.T
    mixed = np.vstack([clean, rng.normal(size=(120, 3)) * 0.3 + [3.0, -3.0, 6.0]])
    pools = {"mixed": mixed, "clean": rng.normal(size=(200, 3)) @ shape.T}
    rows = spark.createDataFrame([(k, *map(float, x)) for k, v in pools.items() for x in v], "pool string, a double, b double, c double").repartition(3)
    floor = np.diag(np.square(ridge))
    found = {r.pool: r for r in quality_mcd.mcd(rows, names, ridge, core).collect()}
    for name, x in pools.items():
        h, best = int(np.ceil(core * len(x))), np.inf
        for _ in range(300):
            keep = rng.choice(len(x), 4, replace=False)
            for _ in range(15):
                d = x - x[keep].mean(0)
                keep = np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x[keep].T, bias=True) + floor), d))[:h]
            best = min(best, np.linalg.slogdet(np.cov(x[keep].T, bias=True) + floor)[1])
        assert best - 1e-9 <= found[name].logdet <= best + 0.25, (name, best, found[name].logdet)
    d = mixed - np.array(found["mixed"].centre)
    far = np.einsum("ij,jk,ik->i", d, np.array(found["mixed"].precision).reshape(3, 3), d) > quality_mcd.chi2_quantile(0.99999, 3)
    assert far[280:].all() and not far[:280].any()


def test_held_out_quality(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    held = bradley_terry.score_quality(documents, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    kept = quality_mcd.quality(documents).join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in kept) >= 0.97 * len(kept)


def test_preference_pairs_awkward(spark, docs):
    """Null, unmatched and contrary labels, repeated rows, one class only, and scores that do not depend on partitions."""
    labels = [(i, i % 2) for i in range(150)] + [(3, 0), (3, 0), (None, 1), (5, None), (6, 7), (777_777, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    plain = docs.select("doc_id", "text")
    found = {p: sorted(((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in bradley_terry.score_quality(plain.repartition(p), table.repartition(p)).collect()), key=key) for p in (1, 5)}
    assert found[1] == found[5] and len(found[1]) == docs.count()
    assert all(0 <= x[2] <= 1 and x[3] == (x[2] >= 0.3) and x[1] == (zlib.crc32(str("" if x[0] is None else x[0]).encode()) % 5 == 0) for x in found[1])
    assert {r.score for r in bradley_terry.score_quality(plain, table.filter("quality = 1")).collect()} == {0.99}
    assert {r.score for r in bradley_terry.score_quality(plain, table.limit(0)).collect()} == {0.5}


def test_preference_pairs_learn_by_logistic_loss():
    """The learnt direction maximises the pairs' likelihood: no small change of the weights makes it better, and repeats count."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0])))).astype(float)
    w, offset, slope = bradley_terry.learn(x, y, penalty=0.0)
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.3 * w[0] and slope > 0
    d = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, 3)
    loss = lambda v: np.log1p(np.exp(-d @ v)).mean()
    assert all(loss(w) <= loss(w + step) + 2e-4 for step in 0.3 * np.vstack([np.eye(3), -np.eye(3)]))
    share = (1 / (1 + np.exp(-(x @ w * slope + offset))) < 0.3).mean()
    assert abs(share - (y == 0).mean()) < 0.02
    twice = bradley_terry.learn(np.vstack([x, x[:50]]), np.r_[y, y[:50]])
    counted = bradley_terry.learn(x, y, np.r_[np.full(50, 2.0), np.ones(350)])
    assert np.abs(twice[0] - counted[0]).max() < 0.1


def test_empty_tables(spark, docs):
    none = docs.filter(F.lit(False))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for frame in (mpeg_audio.media_digest(mpeg_audio.stored_media(none)), simhash_gray.near_duplicates(none), secret_scan.scan(none), mixing.mix(none), bradley_terry.score_quality(none, labels), pii_weak.find(none), sentencepiece_offsets.encode_texts(none, queries.model_path()), suffix_levels.removed_passages(none, batches=2), quality_mcd.quality(none)):
        assert frame.count() == 0
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
    assert docs.count() > 0


def similar_classes(texts, words, percent):
    """For each id the smallest one reachable by links of similar shingle sets, by comparing all pairs."""
    sets = {}
    for i, text in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    for i in sorted(sets):
        near = {group[j] for j in sets if sets[i] == sets[j] or (100 + percent) * len(sets[i] & sets[j]) >= percent * (len(sets[i]) + len(sets[j]))}
        group = {j: min(near) if g in near else g for j, g in group.items()}
    return group


def edited(rng, words, share):
    return [f"{w}x" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("leaders", [16, 0])
def test_near_texts(spark, leaders):
    """Components by exact similarity: chains, a group of copies of copies, awkward rows, against all pairs."""
    rng, texts = random.Random(5), [None, "", " \n", "one", "One", "a b c d e", "A b c d E"]
    vocabulary = [f"w{k}" for k in range(4000)]
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.randrange(80, 400))
        texts.append(" ".join(words))
        for _ in range(4):
            words = edited(rng, words, rng.choice((0.005, 0.01, 0.03)))  # chains: ends of one need not be similar
            texts.append(" ".join(words))
    hub = rng.choices(vocabulary, k=200)
    texts += [" ".join(edited(rng, hub, rng.choice((0.01, 0.04)))) for _ in range(60)] + [" ".join(hub)] * 3
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[9], rows[9]], "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("n", F.lit(0))
    got = near_texts.near_duplicates(df, leaders=leaders).collect()
    true = similar_classes(dict(rows), 5, 80)
    classes = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(rows) + 2 and all(true[i] == true[c] for i, c in classes.items())  # only true links
    lost = len(set(classes.values())) - len(set(true.values()))
    assert len(rows) - len(set(classes.values())) >= 0.9 * (len(rows) - len(set(true.values()))) and lost <= 2
    assert {r.doc_id for r in got if r.keep} == set(classes.values())
    kept = near_texts.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(set(classes.values()))
    assert near_texts.near_duplicates(df.filter(F.lit(False))).count() == 0


def test_near_texts_without_ids(spark):
    """A null id stands for a component only where all ids are null."""
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, text), (7, text), (None, "other words"), (None, "other words")], "doc_id long, text string")
    got = near_texts.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.keep) for r in got) == [(0, 0, True), (0, 0, True), (0, 7, False), (7, 7, True)]
    assert near_texts.keep_one(df).count() == 2


def test_pipeline_against_brute_force(spark):
    """Every stage over what the one before kept, against brute force on the collected rows, and run() against the stages."""
    import corpus_pipeline
    import sentencepiece

    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.cut(stage(spark, docs, DATA), f"test-{name}")
        seen.append((before, docs.collect()))
    quality, dedup, pii, mixture, tokens = seen

    kept = {r.doc_id for r in quality[1]}
    assert set(quality[1]) <= set(quality[0]) and len(kept) == len(quality[1])
    for r in quality[0]:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert not (r.doc_id in kept and (len(w) < 50 or 100 * len(inside) > 50 * len(w)))

    found, true = {r.doc_id for r in dedup[1]}, similar_classes({r.doc_id: r.text for r in dedup[0]}, corpus_pipeline.WORDS, corpus_pipeline.PERCENT)
    assert found == set(true.values()) and set(dedup[1]) <= set(dedup[0])

    masked = {r.doc_id: r for r in pii[1]}
    assert sorted(masked) == sorted(r.doc_id for r in pii[0]) and all(r.n_chars == len(r.text) for r in pii[1])
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    assert any(email.search(r.text) for r in pii[0]) and not any(email.search(r.text) for r in pii[1])
    assert all(masked[r.doc_id].text.count("<EMAIL>") <= len(email.findall(r.text)) for r in pii[0])

    copies = Counter(r.doc_id for r in mixture[1])
    given = spark.createDataFrame(mixture[0], "doc_id long, text string, lang string, source string, n_chars long")
    drawn = {r.doc_id: r.copies for r in mixing.mix(given, queries.source_domains(given)).collect() if r.copies}
    assert copies == drawn and all(masked[r.doc_id] == r for r in mixture[1])

    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    ids = Counter((r.doc_id, tuple(library.encode(r.text))) for r in tokens[0])
    assert Counter((r.doc_id, tuple(r.ids)) for r in tokens[1]) == ids
    assert all(r.decoded == library.decode(list(r.ids)) for r in tokens[1])
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect()) == ids


def test_stages_on_awkward_rows(spark, docs):
    """Nulls, empty and long texts, repeated rows, null ids and clashing columns go through every stage; an empty table as well."""
    import corpus_pipeline

    for given in (docs, docs.filter(F.lit(False))):
        some, columns = given, given.columns
        for name, stage in corpus_pipeline.STAGES:
            before = some.count()
            some = corpus_pipeline.cut(stage(spark, some, DATA), f"awkward-{name}")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert some.columns == columns, name
            assert some.count() <= 2 * before
        assert (some.count() > 0) == (given is docs)
