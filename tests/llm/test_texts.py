"""Licence scan, URL rules, chat and media against definitions; classifiers by held-out accuracy; the pipeline."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import chat, langid, license_scan, media, quality, url_filter
from strandline.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in result.fetchall()), key=repr)


def licences(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.unit, r.position, r.part, r.license) for r in license_scan.scan(rows).collect()}


def test_licences_near_and_far(spark, odd_docs, no_docs):
    grant = license_scan.MIT.partition("\n\n")[0]
    texts = ["x\nReleased under the MIT license\ny", "Released under a MIT-like licence", "licensed under CC-BY NC 4.0!\n\nmore", "mit mit mit mit", None, "The sources are on our site. Released under the MIT License.", "See the docs: Released under the MIT License."]
    assert licences(spark, texts) == {
        (0, "line", 2, 1, "MIT"), (0, "paragraph", 1, 1, "MIT"), (2, "text", 1, 1, "CC-BY-NC-4.0"), (2, "line", 1, 1, "CC-BY-NC-4.0"),
        (5, "sentence", 1, 2, "MIT"), (6, "sentence", 1, 2, "MIT"),
    }
    old = license_scan.TEMPLATES + [("grant", grant)]
    rows = spark.createDataFrame([(1, grant), (2, grant.upper().replace("CONDITIONS", "TERMS", 1))], "doc_id long, text string")
    assert {(r.doc_id, r.unit, r.license) for r in license_scan.scan(rows, old).collect()} == {(1, "paragraph", "grant"), (2, "paragraph", "grant")}
    assert license_scan.scan(odd_docs).count() == 0 and license_scan.scan(no_docs).count() == 0


def test_whole_licence_files(spark):
    """Files as projects have them: a title, a copyright line and the body; as comments; between other text; versions told apart."""
    L = license_scan
    notices = {spdx: (L.GNU_GRANT + "\n\n" + L.GNU_REST).format(work=work, name=name, version=version, where=where) for spdx, work, name, version, where in L.GNU}
    bsd = "\n\n".join([L.BSD_GRANT, L.BSD_ONE, L.BSD_TWO, L.BSD_END])
    bodies = {"MIT": L.MIT, "ISC": L.ISC, "BSD-2-Clause": bsd, "BSD-3-Clause": bsd.replace(L.BSD_END, L.BSD_THREE + "\n\n" + L.BSD_END), "Apache-2.0": L.APACHE_NOTICE, "Zlib": L.ZLIB, "Unlicense": L.UNLICENSE, **notices}
    prose = "Some words about the project, which has nothing to do with this and goes on for a while.\n" * 4
    shapes = {
        "file": "{0} License\n\nCopyright (c) 2020 Some One and all the other people\n\n{1}\n",
        "comment": "#!/bin/sh\n#\n{2}\n#\nset -e\n",
        "between": prose + "\n{1}\n\n" + prose,
        "long": (prose + "\n") * 400 + "{1}\n\n" + prose * 50,
    }
    texts, names = [], []
    for spdx, body in bodies.items():
        for shape in shapes.values():
            texts.append(shape.format(spdx, body, "\n".join(f"# {x}" for x in body.split("\n"))))
            names.append(spdx)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    best = {}
    for r in license_scan.scan(rows).collect():
        best[r.doc_id] = max(best.get(r.doc_id, (0.0, "")), (r.dice, r.license))
    assert [best.get(k, (0, None))[1] for k in range(len(texts))] == names
    assert min(dice for dice, _ in best.values()) > 0.9


def test_every_match_has_a_key_word():
    counted = [(name, license_scan.template_bigrams(text)) for name, text in license_scan.TEMPLATES]
    keys = license_scan.key_words(counted, license_scan.THRESHOLD)
    for _, bigrams in counted:
        covered = sum(c for b, c in bigrams.items() if set(b.split()) & set(keys))
        assert covered > sum(bigrams.values()) * (1 - license_scan.THRESHOLD / (2 - license_scan.THRESHOLD))


def plain_rule(host, path, rules):
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, None, "allow"))[1:]


def test_nested_rules_against_all_rules(spark):
    rng = random.Random(4)
    hosts = [".".join(rng.choice(["a", "b", "cc", "com", "net"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/é/", "/a/b/c"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((rng.choice(hosts), rng.choice(paths)) for _ in range(80))}.values())
    urls = [(k, f"http://{rng.choice(hosts + ['x.' + h for h in hosts]).upper()}{rng.choice(paths)}{rng.choice(['', '?q=/a', '#x'])}") for k in range(400)]
    urls += [(900, None), (901, "no scheme.com/a"), (902, "x://"), (903, "x://com?://net/a"), (904, urls[0][1]), (None, urls[1][1])]
    frame = spark.createDataFrame([(*u, "h") for u in urls], "page_id long, url string, host string")
    got = url_filter.judge(frame, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.rule, r.verdict) == plain_rule(r.host, r.path, rules)
    none = url_filter.judge(frame, spark.createDataFrame([], "host string, path string, verdict string")).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "allow")} and len(none) == len(urls)
    assert url_filter.judge(frame.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_chat_merges_escapes_and_reads_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\l\\e<[+]>", "[+]", "", None, "<s>[user]x</s>", "\\"]
    rows = [(1, k, role, t) for k, (role, t) in enumerate(zip(["user", "user", "assistant", "assistant", "system", "assistant", None], nasty))]
    rows += [(2, 0, "a]b", "x"), (2, 0, "a]b", "x"), (None, 1, "assistant", "only")]
    out = chat.format_conversations(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, formatted string"))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:7]]
    assert got[1].formatted.count("<s>[") == 5
    assert got[1].loss == "[+]" + "" + "<s>[user]x</s>"
    assert [(t.role, t.text) for t in got[2].turns] == [("a]b", "x")] * 2 and got[None].loss == "only"
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_png_filters_and_damage():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 256, (30, 64), np.uint8)

    def paeth(a, b, c):
        p = int(a) + int(b) - int(c)
        return min((abs(p - int(a)), 0, a), (abs(p - int(b)), 1, b), (abs(p - int(c)), 2, c))[2]

    kinds = rng.integers(0, 5, 30).astype(np.uint8)
    lines = np.zeros_like(rows)
    for r in range(30):
        for x in range(64):
            a, b, c = (int(rows[r, x - 1]) if x else 0), (int(rows[r - 1, x]) if r else 0), (int(rows[r - 1, x - 1]) if x and r else 0)
            lines[r, x] = (int(rows[r, x]) - [0, a, b, (a + b) // 2, int(paeth(a, b, c))][kinds[r]]) % 256
    assert (media.unfiltered(kinds, lines) == rows).all()
    png = media.write_png(rows.tobytes(), 1900)
    assert media.read_png(png)[1] == 1900 and (media.read_png(png)[0] == rows).all()
    for at in (3, 20, len(png) - 20):
        with pytest.raises(ValueError):
            media.read_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(ValueError):
        media.read_png(png[:-12])


def plain_hash(rows):
    """Means of 32 x 32 parts and the cosine transform, each by its definition."""
    n = [len(rows), len(rows[0])]

    def span(k, size):
        return [k * size // 32] if size < 32 else range(k * size // 32, (k + 1) * size // 32)

    small = [[float(np.mean([[rows[a][b] for b in span(x, n[1])] for a in span(y, n[0])])) for x in range(32)] for y in range(32)]
    low = [
        sum(small[y][x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32))
        for u in range(8) for v in range(8)
    ]
    low = [round(value, 6) for value in low]
    middle = sorted(low[1:])[31]
    return [value > middle for value in low]


@pytest.mark.parametrize("height", [1, 20, 32, 75])
def test_cosine_hash_by_definition(height):
    rows = np.random.default_rng(height).integers(0, 256, (height, 64), np.uint8)
    want = plain_hash(rows.tolist())
    found = np.unpackbits(np.frombuffer(bytes.fromhex(media.cosine_hash(rows)), np.uint8)).astype(bool)
    assert found.tolist() == want


def plain_png(data):
    """Samples of a grey picture, by the format's definition, one after the other."""
    at, packed, size = 8, b"", None
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        assert int.from_bytes(data[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + body)
        size = (int.from_bytes(body[4:8], "big"), int.from_bytes(body[:4], "big")) if kind == b"IHDR" else size
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, rows = zlib.decompress(packed), []
    for r in range(size[0]):
        kind, line = raw[r * (size[1] + 1)], raw[r * (size[1] + 1) + 1 : (r + 1) * (size[1] + 1)]
        row = []
        for x, value in enumerate(line):
            row.append((value + [0, row[x - 1] if x else 0, rows[-1][x] if rows else 0][kind]) % 256)
        rows.append(row)
    return rows


def test_stored_pictures_by_definition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(25)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in media.read(media.store(docs)).collect():
        rows = plain_png(bytes(r.media))
        assert bytes(sum(rows, [])) == media.padded(texts[r.doc_id]) == bytes(r.payload)
        assert r.feature == media.cosine_hash(np.array(rows, np.uint8))


def test_media_rows(odd_docs, no_docs):
    rows = media.read(media.store(odd_docs)).collect()
    texts = [(r.text or "").encode() for r in odd_docs.collect()]
    assert sorted(bytes(r.payload[: r.n_bytes]) for r in rows) == sorted(texts)
    assert all(len(r.payload) % 64 == 0 and len(r.payload) >= 64 for r in rows)
    same = [r for r in rows if r.doc_id == 1]
    assert same[0].media == same[1].media and same[0].feature == same[1].feature
    assert media.read(media.store(no_docs)).count() == 0


def test_query_op9(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op9_png_media"](spark, sf_dir).collect():
        data = docs[r.doc_id]
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_phrases_as_greedy_parsing():
    """Longest matches from left to right; a symbol that the sample lacks is a phrase, and ends the one before it."""
    samples = [("x", ["the cat sat on the mat and ran"]), ("y", ["der hund lief um das haus herum"])]
    model = langid.fit(samples)
    for text in ("the mat sat", "der hund und die katze", "a", "the 漢 mat", "rrr qqq", ""):
        codes = model.codes(text).tolist()
        for k, (_, texts) in enumerate(samples):
            own = [langid.SEPARATOR, *model.codes(texts[0]).tolist()]
            known = {tuple(own[i:j]) for i in range(len(own)) for j in range(i + 1, len(own) + 1)}
            phrases, run = 1 if codes else 0, ()
            for c in codes:
                if (*run, c) in known:
                    run = (*run, c)
                else:
                    phrases, run = phrases + 1, (c,) if (c,) in known else ()
            assert int(model.phrases([np.array(codes, np.uint8)])[0, k]) == phrases


def test_language_held_out(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = QUERIES["op5_cross_parsing_language"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    model = langid.fit(langid.sample(docs))
    found = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    assert {k: found[k].lang_pred for k in (2, 3, 5)} == {k: "und" for k in (2, 3, 5)} and found[6].lang_pred != "und"
    kept = langid.with_language(odd_docs, langid.fit_gate(docs, model))
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} <= {None, 1, 4, 6}
    assert langid.with_language(no_docs, langid.fit_gate(no_docs, model)).count() == 0
    assert langid.identify(no_docs, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, langid.fit(langid.sample(no_docs))).collect()} == {"und"}


def test_languages_of_short_and_long_texts_only(spark):
    """Labels without a text of the preferred length are learned too; without any label, lettered texts stay."""
    rng = random.Random(4)
    en, de = "the cat and this other one that were there with them".split(), "der Hund und die andere Katze ist nicht mit ihm dort".split()
    rows = [(k, " ".join(rng.choice(en) for _ in range(12)), "en") for k in range(60)]
    rows += [(100 + k, " ".join(rng.choice(de) for _ in range(5000)), "de") for k in range(3)] + [(200, "12 34", "xx"), (201, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.sample(docs)
    assert [(name, len(texts)) for name, texts in samples] == [("de", 3), ("en", 60)]
    assert max(len(t) for _, texts in samples for t in texts) == langid.LONGEST_SAMPLE
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.fit(samples)).collect()}
    assert all(found[k] == lang for k, _, lang in rows if k < 200) and found[200] == found[201] == "und"
    none = langid.fit(langid.sample(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert sorted(r.doc_id for r in langid.with_language(docs, langid.fit_gate(docs, none)).collect()) == [k for k, *_ in rows if k < 200]


def test_gate_against_its_definition(spark):
    """Mislabelled and foreign texts go, short ones and those without a label stay; thresholds as recomputed from the rows."""
    rng = random.Random(12)
    words = {name: ["".join(rng.choice(signs) for _ in range(rng.randint(2, 7))) for _ in range(60)] for name, signs in (("aa", "abcdefg"), ("bb", "defghijk"), ("??", "стуфхцч"))}
    rows = [(k, " ".join(rng.choice(words[name]) for _ in range(80)), name) for name in ("aa", "bb") for k in range(1000 * (name == "bb"), 1000 * (name == "bb") + 300)]
    rows += [(5000, " ".join(words["aa"]), "bb"), (5001, " ".join(words["??"]), "aa"), (5002, "стуфх", "aa"), (5003, " ".join(words["aa"]), None), (5004, " ".join(words["bb"][:5]), "aa"), (5005, None, "aa"), (5006, "12", "aa")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(langid.sample(docs.filter(~langid.held_out() & (F.col("doc_id") < 5000))))
    gate = langid.fit_gate(docs, model)
    own = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0 and any(c.isalpha() for c in r[1] or "") and r[2] in model.labels]
    labels, score, letters, bits, margin = model.judge([r[1] for r in own])
    right = np.array([r[2] == p for r, p in zip(own, labels)])
    wide = margin >= langid.ROOM * model.phrase_bits
    assert gate.sure == min(s for s in score[wide] if right[wide & (score >= s)].mean() >= langid.RIGHT)
    assert abs(gate.most_bits - langid.BITS_MARGIN * (bits * letters).sum() / letters.sum()) < 1e-9
    assert gate.room >= langid.ROOM * model.phrase_bits and ((bits - gate.most_bits) * letters > gate.room).sum() <= max(1, len(own) * (1 - langid.RIGHT))
    kept = {r.doc_id for r in langid.with_language(docs, gate).collect()}
    # Four words are enough to contradict a label, five foreign letters are not enough to tell anything.
    assert {r[0] for r in rows} - kept == {5000, 5001, 5004, 5005, 5006}


def plain_language(text, samples):
    """The label with the fewest longest-match phrases, by substring search, of labels with the longer sample first."""
    def symbols(t):
        out = ""
        for c in t.lower():
            c = c if c.isalpha() else "\0"
            out += "" if c == "\0" == out[-1:] else c
        return out

    best = []
    for at, (label, texts) in enumerate(samples):
        learned = ("\0" + "\0".join(map(symbols, texts)))[: langid.SAMPLE_SYMBOLS]
        phrases, own = 0, symbols(text)
        for begin in range(0, len(own), langid.STRETCH):
            phrases, run = phrases + 1, ""
            for c in own[begin : begin + langid.STRETCH]:
                if run + c in learned:
                    run += c
                else:
                    phrases, run = phrases + 1, c if c in learned else ""
        best.append((phrases, -len(learned), at, label))
    return min(best)[-1] if any(c.isalpha() for c in text) else "und"


@pytest.mark.parametrize("stray", ["ok", "o", "ciao", "test doc", "una parola che si dice ogni tanto " * 3, "quando la sera scende sul mare e le luci della costa si accendono piano " * 14])
def test_a_label_with_little_text_takes_no_others(spark, sf_dir, stray):
    """A stray label of a few letters to a thousand leaves held-out predictions as right as they are without it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    more = docs.union(spark.createDataFrame([(10**9 + 1, stray, "xx")], docs.schema))
    samples = langid.sample(more.filter(~langid.held_out()))
    model = langid.fit(samples)
    assert "xx" in model.scarce and model.labels == sorted({*model.labels, "xx"})
    held = [r for r in docs.filter(langid.held_out()).collect() if any(c.isalpha() for c in r.text or "")]
    got = model.judge([r.text for r in held])[0]
    assert np.mean([r.lang == p for r, p in zip(held, got)]) > 0.95 and "xx" not in got
    some = [r.text[:400] for r in held[:12]] + [stray, "Ok. Ciao!", "12"]
    assert model.judge(some)[0] == [plain_language(t, samples) for t in some]


def test_stretches_and_small_tables(monkeypatch):
    """A text is parsed in stretches from their starts; tables with fewer columns give the same phrases."""
    rng = random.Random(13)
    samples = [(name, ["".join(rng.choice(signs) for _ in range(3000))]) for name, signs in (("x", "abcd efgh"), ("y", "abчшщ 漢字"))]
    model = langid.fit(samples)
    text = "".join(rng.choice("abcdefgh漢字чшщ ") for _ in range(3 * langid.STRETCH))
    codes = model.codes(text)
    for n in (langid.STRETCH - 1, langid.STRETCH, langid.STRETCH + 1, 2 * langid.STRETCH + 1):
        parts = [codes[k : min(k + langid.STRETCH, n)] for k in range(0, n, langid.STRETCH)]
        assert (model.phrases([codes[:n]])[0] == model.phrases(parts).sum(axis=0)).all()
    monkeypatch.setattr(langid, "TABLE_BYTES", 200_000)
    small = langid.fit(samples)
    assert all(t.flat.nbytes < u.flat.nbytes for t, u in zip(small.tables, model.tables))
    assert (small.phrases([codes, codes[:70]]) == model.phrases([codes, codes[:70]])).all()


def test_languages_of_many_scripts():
    """Labels with thousands of different letters between them: phrases as by definition, and each label found."""
    rng = random.Random(6)
    scripts = {"el": (0x3B1, 24), "ja": (0x4E00, 900), "ko": (0xAC00, 700), "la": (0x61, 26), "ru": (0x430, 32), "zh": (0x5E00, 900)}
    words = {name: ["".join(chr(first + rng.randrange(n)) for _ in range(rng.randint(1, 5))) for _ in range(150)] for name, (first, n) in scripts.items()}
    # Two languages that share their script.
    words["zh"] = [w[::-1] for w in words["ja"][:20]] + words["zh"]
    text = lambda name, n: " ".join(rng.choice(words[name]) for _ in range(n))
    samples = [(name, [text(name, 60) for _ in range(12 if name == "la" else 40)]) for name in sorted(scripts)]
    model = langid.fit(samples)
    texts = [text(name, 40) for name in sorted(scripts) for _ in range(10)]
    assert model.judge(texts)[0] == [name for name in sorted(scripts) for _ in range(10)]
    assert any(len(t.keys) for t in model.tables) and all(t.flat.size <= 2 * 64 * langid.SAMPLE_SYMBOLS for t in model.tables)
    mixed = [text("ja", 5) + text("ru", 3) + "\u0e01\u0e02 " + text("zh", 5), *texts[::9]]
    got = model.phrases([model.codes(t) for t in mixed])
    for k, (_, own) in enumerate(samples):
        learned = "\0" + "\0".join("".join(map(chr, model.codes(t).tolist())) for t in own)
        learned = learned[: langid.SAMPLE_SYMBOLS]
        for t, found in zip(mixed, got[:, k]):
            phrases, run = 1, ""
            for c in map(chr, model.codes(t).tolist()):
                if run + c in learned:
                    run += c
                else:
                    phrases, run = phrases + 1, c if c in learned else ""
            assert found == phrases


def test_quality_held_out(spark, sf_dir, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.filter("doc_id % 3 <> 0"))
    own = labels.filter("doc_id % 3 = 0").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("p")).filter("q = p")
    rows = quality.score(docs, model).join(own, "doc_id").collect()
    good, bad = [r.score for r in rows if r.q == 1], [r.score for r in rows if r.q == 0]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.9
    assert np.mean([r.keep for r in rows if r.q == 1]) > 0.95
    assert quality.score(odd_docs, model).count() == odd_docs.count() and quality.score(no_docs, model).count() == 0
    assert quality.good_rows(odd_docs, model).columns == odd_docs.columns
    assert quality.fit(docs, labels.limit(0)).constant == 0.5
    assert quality.fit(docs, labels.filter("quality = 1")).constant == 1.0


def made_pages(n, rng, told=0.08):
    """Pages whose words and whose source both hint at their quality, a few of them labelled."""
    good, bad, both = ([f"{stem}{k}" for k in range(40)] for stem in ("lucid", "spam", "word"))
    rows, truth = [], {}
    for k in range(n):
        y = rng.random() < 0.5
        words = [rng.choice((good if y else bad) if rng.random() < told else both) for _ in range(40)]
        source = f"{'site' if (rng.random() < 0.97) == y else 'blog'}{rng.randrange(8)}"
        rows.append((k, " ".join(words) if k % 97 else None, "en", source, 200 if k % 89 else None))
        truth[k] = int(y)
    return rows, truth


def test_cotraining_against_plain_rounds(spark, monkeypatch):
    """Pseudo-labels by sorting all rows in one list, round by round; the model's weights and scores are the same."""
    monkeypatch.setattr(quality, "PSEUDO", 30)
    rows, truth = made_pages(600, random.Random(14))
    rows += [(1000 + k, *rows[5][1:]) for k in range(40)]  # copies
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = [k for k in range(600) if k % 5 == 0]
    labels = spark.createDataFrame([(k, truth[k]) for k in known] + [(3, 0), (3, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    order = [r[0] for r in spark.createDataFrame([(k,) for k in known], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    views = {r[0]: (quality.content_view(r[1] or ""), quality.metadata_view(*r[2:])) for r in rows}
    training = quality.Training([np.array([views[k][v] for k in order]) for v in range(2)], np.array([truth[k] for k in order]))
    taken, added = [set(), set()], 0
    for _ in range(quality.ROUNDS):
        now = training.model()
        margins = {k: tuple(float(m[0]) - np.log(training.prior / (1 - training.prior)) for m in now.margins([views[k][0][None], views[k][1][None]])) for k in views}
        for pupil, teacher in ((0, 1), (1, 0)):
            one = {}
            for k in sorted(views):
                if k not in known and k != 3:
                    one.setdefault((round(margins[k][0], 9), round(margins[k][1], 9)), k)
            free = sorted((k for k in one.values() if k not in taken[pupil]), key=lambda k: (margins[k][teacher], k))
            picks = [(k, 0) for k in free if margins[k][teacher] <= -np.log(quality.SURE)][: training.quotas()[0]]
            picks += [(k, 1) for k in sorted(free, key=lambda k: (-margins[k][teacher], k)) if margins[k][teacher] >= np.log(quality.SURE)][: training.quotas()[1]]
            taken[pupil] |= {k for k, _ in picks}
            added += len(picks)
            if picks:
                training.add(pupil, np.array([views[k][pupil] for k, _ in picks]), np.array([float(y) for _, y in picks]))
    plain = training.model()
    assert added > 60 and not taken[0] & set(known)
    for a, b in zip(model.views, plain.views):
        assert np.allclose(a.weight, b.weight, atol=1e-6)
    assert np.allclose(model.joint, plain.joint, atol=1e-6) and abs(model.threshold - plain.threshold) < 1e-6


def test_rounds_help_the_views(spark):
    """With few labels and two views that both tell something, exchanged labels make each view better."""
    rows, truth = made_pages(1500, random.Random(15), 0.03)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, truth[k]) for k in range(0, 1500, 12)], "doc_id long, quality int")

    def areas(rounds):
        found = quality.score(docs, quality.fit(docs, labels, rounds=rounds)).filter("doc_id % 12 <> 0").collect()
        good, bad = ([r for r in found if truth[r.doc_id] == y] for y in (1, 0))
        return {c: np.mean([(a[c] > b[c]) + (a[c] == b[c]) / 2 for a in good for b in bad]) for c in ("content_score", "metadata_score", "score")}

    alone, together = areas(0), areas(quality.ROUNDS)
    assert together["content_score"] > alone["content_score"] + 0.05 and together["score"] > alone["score"] - 0.005


def test_pipeline_stages_against_plain_ones(spark, sf_dir):
    """Each stage's kept rows, from its own input, by loops over all of it."""
    import base64

    import corpus_pipeline
    import public_tokenizers
    import tiktoken
    from test_near import plain_hits, plain_survivors

    now, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = corpus_pipeline.written(stage(spark, now, sf_dir), "stage")
        seen[name] = before, now.collect()
    before, after = seen["quality classifier"]
    docs = spark.createDataFrame(before, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = model.score([np.array([quality.content_view(r.text or "") for r in before]), np.array([quality.metadata_view(r.lang, r.source, r.n_chars) for r in before])])[2]
    assert sorted(r for r, p in zip(before, scores) if p >= model.threshold) == sorted(after) and len(after) < len(before)
    before, after = seen["language ID"]
    docs = spark.createDataFrame(before, docs.schema)
    gate = langid.fit_gate(docs, langid.fit(langid.sample(docs.filter(~langid.held_out()))))
    kept = []
    for r in before:
        (label,), (score,), (letters,), (bits,), (margin,) = gate.model.judge([r.text])
        if letters and (bits - gate.most_bits) * letters <= gate.room and not (r.lang in gate.model.labels and r.lang != label and score >= gate.sure and margin >= langid.ROOM * gate.model.phrase_bits):
            kept.append(r)
    assert sorted(kept) == sorted(after)
    before, after = seen["SimHash near-dedup"]
    assert sorted(r.doc_id for r in after) == plain_survivors([r.doc_id for r in before], [r.text or "" for r in before])
    before, after = seen["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {before[n].doc_id for n, _ in plain_hits([r.text or "" for r in before], items)}
    assert hit and {r.doc_id for r in after} == {r.doc_id for r in before} - hit
    before, after = seen["byte-level BPE"]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in before}
    assert all(np.frombuffer(r.ids, "<u4").tolist() == whole.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) // 4 for r in after) and len(after) == len(before)


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, odd_docs, no_docs):
    import corpus_pipeline

    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "of a few words."), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder)
            assert now.columns == docs.columns
            now = corpus_pipeline.written(now, "odd")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in now.collect())
        assert len(rows) <= docs.count() and not {2, 3, 5, None} & {r.doc_id for r in rows}


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir).cache()
        if name != names[-1]:
            assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > sizes[4] == sizes[5] > 0.5 * sizes[0]
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == {r.doc_id for r in now.select("doc_id").collect()}


def test_every_licence_is_found_as_itself(spark):
    """Each template alone gives its own name and nothing nearer; forms in which rivals differ by a word, too."""
    own = [(name, text) for name, text in license_scan.TEMPLATES]
    own += [
        ("CC-BY-ND-4.0", "Our pictures are on the site.\n\nThis work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
        ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
        ("CC-BY-NC-ND-3.0", "licensed under CC-BY-NC-ND 3.0"),
        ("GPL-1.0", "This work is licensed under the GNU General Public License, version 1."),
        ("GPL-2.0-only", "// SPDX-License-Identifier: GPL-2.0-only"),
        ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2 only"),
        ("MIT", "# SPDX-License-Identifier: MIT"),
        ("BSD", "Released under the BSD license"),
    ]
    rows = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(own)], "doc_id long, text string")
    best: dict[int, tuple] = {}
    for r in license_scan.scan(rows).collect():
        best[r.doc_id] = max(best.get(r.doc_id, (0.0, "")), (r.dice, r.license))
    assert [best.get(k, (0, None))[1] for k in range(len(own))] == [name for name, _ in own]
    assert all(best[k][0] == 1.0 for k in range(len(license_scan.TEMPLATES)))
