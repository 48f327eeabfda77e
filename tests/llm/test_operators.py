"""The training-data operators against brute force, and on odd rows: nulls, empty and long texts, repeats, clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modalens.llm import components, fingerprints, lang_id, licences, media, mixing, near_dup, packing, pii, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, g int, h int, band string, size string"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards brew fine potions under a pale moon tonight and nobody else is awake"
TEXTS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, BASE.replace("tonight", "today"), "en", "b"),
    (4, BASE.upper(), "en", "b"),
    (5, None, "en", None),
    (6, "", None, "a"),
    (7, "   \n\t ", "fr", None),
    (8, "mot", "fr", "c"),
    (9, "été déjà vu 12345 ² ½ 漢字 <|endoftext|> x", "fr", "c"),
    (10, "word " * 4000, "de", "c"),
    (10, "word " * 4000, "de", "c"),
    (None, "nobody's text is here and it is long enough to matter for windows", "de", "c"),
    (-3, "negative ids come first and " + BASE, "en", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, len(t or ""), "x", 1, 2, "b", "s") for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_token_counts_equal_the_library(docs, real, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for table in (docs, real):
        text = texts_of(table)
        for r in token_counts.token_counts(table, path).collect():
            n = len(tok.encode(text[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 512)
    assert token_counts.token_counts(empty, path).count() == 0


def test_rare_pre_tokens_are_joined_by_a_shuffle(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(docs, path).collect())
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(docs, path, common=5).collect()) == want


def shingle_set(t, w):
    words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(zip(*[words[i:] for i in range(w)], strict=False)) if len(words) >= w else frozenset([tuple(words)] if words else [])


def brute_components(sets, percent=80):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("w", [2, 5])
def test_near_duplicates_equal_brute_force(docs, real, w):
    for table in (docs.filter("doc_id IS NOT NULL"), real):
        sets = {i: shingle_set(t, w) for i, t in texts_of(table).items()}
        want = brute_components(sets)
        for r in near_dup.near_duplicates(table, w=w).collect():
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_odd_rows(docs, empty):
    assert near_dup.near_duplicates(empty).count() == 0
    rows = near_dup.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    assert [r.kept for r in rows if r.doc_id is None] == [True]


def test_every_sketch_coordinate_is_filled_and_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 62, 1200).astype(np.uint64)
    a, b = pool[:1000], pool[200:]
    s = near_dup.sketches(np.concatenate([a, b, pool[:1]]), np.array([1000, 1000, 1]), 400)
    assert (s != near_dup._LAST).all()
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.1


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.label for r in components.components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_licences_and_inheritance(spark, empty):
    rows = [
        (1, "/a/LICENSE", "Released under the MIT License."), (2, "/a/b/c/x.py", "print(1)"), (3, "/a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "/a/b/c/y.py", "# Licensed under CC BY-NC 4.0.\ncode"), (5, "/q/z.py", "none"), (6, None, "Released under the MIT License."), (7, "/a/w", None), (8, "/a/v", ""),
        (9, "/a/b", "no licence in sight, as it were, of any sort that is known"),
    ]
    out = {r.doc_id: r for r in licences.licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [out[i].license for i in range(1, 10)] == ["MIT", "Apache-2.0", "Apache-2.0", "CC-BY-NC-4.0", None, "MIT", "MIT", "MIT", "MIT"]
    assert (out[2].license_dir, out[7].license_dir, out[4].license_dir) == ("/a/b", "/a", None)
    assert licences.licences(empty.withColumn("path", F.lit("/x/y"))).count() == 0


def brute_licences(rows, least=0.5):
    """The same scores by plain dictionaries, and inheritance by walking up each path."""
    folder = Path(licences.__file__).with_name("licence_texts")
    term = lambda t: Counter(re.findall(licences.TERM, t.lower(), re.A))
    headers = {}
    for k, (_, path, text) in enumerate(rows):
        if text and re.search(licences.MARK, text):
            lines = "\n".join(x for x in text.split("\n") if re.search(licences.MARK, x))
            whole = bool(re.search(licences.LICENCE_FILE, (path or "").rpartition("/")[2]))
            flat = re.sub(r"\s+", " ", text)
            titles = tuple(n for n, (_, phrase) in licences.BODIES.items() if whole and re.search(phrase, flat, re.I))
            headers[k] = {(titles, tuple(sorted(term(t).elements()))) for t in ([lines, text] if whole else [lines])}
    n = sum(len(h) for h in headers.values())
    df = Counter(t for h in headers.values() for _, words in h for t in set(words))
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1

    def cosine(words, text):
        a, b = Counter(words), term(text)
        length = lambda x: math.sqrt(sum((c * idf(t)) ** 2 for t, c in x.items()))
        dot = sum(c * b[t] * idf(t) ** 2 for t, c in a.items() if t in b)
        return round(dot / (length(a) * length(b)), 6) if dot else 0

    own, score = {}, {}
    for k, h in headers.items():
        found = [(-cosine(words, t), name) for titles, words in h for name, t in licences.TEMPLATES.items()]
        found += [(-cosine(words, (folder / f"{licences.BODIES[name][0]}.txt").read_text("utf-8")), name) for titles, words in h for name in titles]
        best = min(x for x in found if x[0])
        score[k] = -best[0]
        own[k] = best[1] if score[k] >= least else None
    dirs = {}
    for k, (_, path, _) in enumerate(rows):
        if own.get(k) and path and "/" in path and re.search(licences.LICENCE_FILE, path.rpartition("/")[2]):
            d = path.rpartition("/")[0]
            dirs[d] = min(dirs.get(d, own[k]), own[k])
    out = []
    for k, (i, path, _) in enumerate(rows):
        at, d = None, (path or "").rpartition("/")[0] if "/" in (path or "") else None
        while not own.get(k) and d is not None and at is None:
            at = d if d in dirs else None
            d = d.rpartition("/")[0] if "/" in d else None
        out.append((i, path, own.get(k), score.get(k), own.get(k) or dirs.get(at), at))
    return out


def test_licences_equal_brute_force(spark, real):
    from modalens.llm.queries import with_paths

    notices = list(licences.TEMPLATES.values())
    odd = [(5000, None, notices[0]), (5001, "LICENSE", notices[1]), (5002, "/LICENSE", notices[2]), (5003, "/x", None), (5004, "/x", "nothing"), (5005, "/z/COPYING", notices[3]), (5006, "/z/LICENSE", notices[4])]
    odd += [(5007, "/z/y/w", ""), (5008, "/z/y/w", "prose"), (5008, "/z/y/w", "prose"), (5009, "x.txt", "prose"), (5010, "/z/y/LICENSE.md", "a licence of no known sort"), (5011, "/v/a", notices[0] + "\n" + notices[5])]
    rows = [(r.doc_id, r.path, r.text) for r in with_paths(real).collect()] + odd
    table = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("own")).withColumn("term", F.lit(1))
    text = lambda r: tuple("" if x is None else x for x in r)
    got = sorted((text((r.doc_id, r.path, r.own_license, r.score, r.license, r.license_dir)) for r in licences.licences(table).collect()), key=str)
    want = sorted(map(text, brute_licences(rows)), key=str)
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert all(abs((a[3] or 0) - (b[3] or 0)) < 1e-5 for a, b in zip(got, want, strict=True))
    assert sum(1 for x in got if x[5]) > 20


def test_licence_files_with_a_notice_in_prose_and_with_full_texts(spark):
    folder = Path(licences.__file__).with_name("licence_texts")
    body = lambda name: (folder / f"{name}.txt").read_text()
    prose = "\n".join(f"w{i} the of and to in that for it was x{i % 97} y{i % 89}" for i in range(300))
    mit = body("MIT").replace("<year> <copyright holders>", "2024 A. Person and many other people").replace("\n", "\n\n")
    by = body("CC-BY-SA-4.0").replace("ShareAlike", "").replace("Attribution- ", "Attribution ").replace("Attribution-4", "Attribution 4")
    rows = [
        (1, "/a/LICENSE", f"{prose}\nThis work is licensed under the GNU General Public License, version 3.\n{prose}"), (2, "/a/x.py", "none"),
        (3, "/b/COPYING", body("GPL-3.0")), (4, "/c/LICENSE.txt", body("Apache-2.0").upper()), (5, "/d/LICENSE", mit), (6, "/d/e/x", None),
        (7, "/f/LICENSE", body("CC-BY-SA-4.0")), (8, "/g/LICENSE", by.replace("Attribution-", "Attribution")), (9, "/h/LICENSE", body("BSD-2-Clause")),
        (10, "/i/LICENSE", body("BSD-3-Clause")), (11, "/j/LICENSE", f"{prose}\nA word on a permit or a license is all that this has.\n{prose}"), (12, "/k/LICENSE", body("LGPL-3.0")),
    ]
    out = {r.doc_id: r for r in licences.licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert len(out) == len(rows)
    assert [out[i].license for i in range(1, 13)] == [
        "GPL-3.0", "GPL-3.0", "GPL-3.0", "Apache-2.0", "MIT", "MIT", "CC-BY-SA-4.0", "CC-BY-4.0", "BSD-2-Clause", "BSD-3-Clause", None, "LGPL-3.0",
    ]
    assert (out[2].license_dir, out[6].license_dir, out[1].own_license) == ("/a", "/d", "GPL-3.0")


def jaccard(a, b):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (a, b))
    every = set(a) | set(b)
    return sum(min(a[x], b[x]) for x in every) / sum(max(a[x], b[x]) for x in every) if every else 1.0


def test_fingerprints_estimate_generalised_jaccard(docs, real, empty):
    assert fingerprints.fingerprints(empty).count() == 0
    for table in (docs, real):
        order = sorted(((r.doc_id, r.text or "") for r in table.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        rank = lambda i, sha: (i is not None, i or 0, sha)
        got = sorted(fingerprints.fingerprints(table).collect(), key=lambda r: rank(r.doc_id, r.edited_sha256))
        want, gaps = [], []
        for k, (i, t) in enumerate(order):
            nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
            edited = t[: len(t) - half] + nxt[:half]
            want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(t, edited), jaccard(t, nxt)))
        for r, w in zip(got, sorted(want, key=lambda w: rank(w[0], w[2])), strict=True):
            assert (r.doc_id, r.n_chars, r.edited_sha256) == w[:3]
            gaps += [r.near_edited - w[3], r.near_next - w[4]]
        assert max(map(abs, gaps)) < 0.3 and abs(sum(gaps) / len(gaps)) < 0.03
        assert len({r.fingerprint for r in got}) <= len({t for _, t in order})


def test_buckets_follow_ids_far_apart_and_split_hot_ones(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 20)
    rows = [(i, f"text {i}") for i in range(300)] + [(77, f"hot {k}") for k in range(200)] + [(None, f"none {k}") for k in range(50)]
    rows += [(-(1 << 63), "least"), ((1 << 63) - 1, "most"), (6 * 10**18, "far")]
    table, n = fingerprints.bucketed(spark.createDataFrame(rows, "id long, text string"))
    got = sorted(((r.bucket, r.id is not None, r.id or 0, r.o) for r in table.collect()))
    assert [x[1:3] for x in got] == sorted(x[1:3] for x in got) and len(got) == len(rows) and got[-1][0] < n
    assert max(Counter(x[0] for x in got).values()) < 40
    assert fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)


@pytest.mark.parametrize("together", [1000, 3])
def test_following_bucket_wraps_around(spark, monkeypatch, together):
    monkeypatch.setattr(fingerprints, "TOGETHER", together)
    have = [0, 1, 5, 6, 7, 20, 40, 41]
    rows = fingerprints.following(spark.createDataFrame([(x,) for x in have], "bucket long"), 41).collect()
    assert {r.bucket: r.after for r in rows} == dict(zip(have, have[1:] + have[:1], strict=True))


def test_code_lengths_are_exact():
    samples = {"a": ["abracadabra", "barn"], "b": ["xyzzy", "zyx"]}
    model = lang_id.Model(samples)

    def brute(lang, text):
        counts: dict = {}
        for s in samples[lang]:
            b = b"\n" * lang_id.ORDER + s.encode()
            for i in range(lang_id.ORDER, len(b)):
                for k in range(lang_id.ORDER + 1):
                    counts.setdefault(b[i - k : i], Counter())[b[i]] += 1
        b, bits = b"\n" * lang_id.ORDER + text.encode(), 0.0
        for i in range(lang_id.ORDER, len(b)):
            for k in range(lang_id.ORDER, -1, -1):
                if c := counts.get(b[i - k : i]):
                    n, d = sum(c.values()), len(c)
                    if b[i] in c:
                        bits += math.log2((n + d) / c[b[i]])
                        break
                    bits += math.log2((n + d) / d)
            else:
                bits += 8
        return bits

    for text in ("abra", "zyzzyva", "qq", "barn xyz"):
        data, _ = lang_id.encode([text])
        assert np.allclose(model.bits(data).sum(0), [brute("a", text), brute("b", text)], rtol=1e-5)


def test_language_held_out_accuracy(real, docs, empty):
    rows = lang_id.language(real).join(real.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows)
    odd = lang_id.language(docs).collect()
    assert {r.lang_pred for r in odd if r.doc_id in (5, 6, 7)} == {"und"} and len(odd) == len(TEXTS)
    assert all(0 <= r.score <= 1 for r in odd)
    assert lang_id.language(empty).count() == 0


def test_media_round_trip(docs, empty):
    text = texts_of(docs)
    for r in media.media_digest(docs).collect():
        raw = text[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.store(payload)).hexdigest()
    assert media.media_digest(empty).count() == 0
    r = media.media_column(docs.filter("doc_id = 1")).first()
    assert len(r.rgb) == r.width * r.height * 3 and media.load(media.Image(bytes(r.media))).rstrip(b"\0") == BASE.encode()


def test_progressive_scans_of_any_coefficients():
    rng = np.random.default_rng(1)
    for trial in range(12):
        w, h = (int(x) for x in rng.integers(1, 4, 2))
        parts = []
        for k in (4, 1, 1):
            x = rng.integers(-200, 200, (w * h * k, 64))
            x[rng.random(x.shape) < (0, 0.5, 0.97)[trial % 3]] = 0
            x[:, 0] = rng.integers(-100, 100, len(x))
            if trial % 2:
                x = np.where(rng.random(x.shape) < 0.5, x % 3 - 1, x)
            parts.append(x.astype(np.int32))
        image = media.Image(media.encode_image(parts, 16 * w, 16 * h))
        assert all((a == b).all() for a, b in zip(image.blocks, parts, strict=True))
        assert image.rgb().shape == (16 * h, 16 * w, 3)


def test_inverse_transform():
    y = np.zeros((4, 64), np.int32)
    y[0, 0] = 80
    image = media.Image(media.encode_image([y, np.zeros((1, 64), np.int32), np.zeros((1, 64), np.int32)], 16, 16))
    assert (image.rgb()[:8, :8] == 138).all() and (image.rgb()[8:, 8:] == 128).all()


E_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in E_MAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15])


def test_plain_spans_equal_the_patterns(real):
    odd = ["a@b.c@d.e.f x@@y.z 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "+1 (222) 333-4444 5) 4111 1111 1111 1111 4111-1111-1111-1111-", "+1(((((((", "aa@bb@cc.dd", "9" * 5000 + "." * 9, "1.1.1.1" * 50]
    for t in [*texts_of(real).values(), *odd]:
        assert pii.find(t)[0] == plain(t)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail joe [at] example [dot] com now", ["joe [at] example [dot] com"]),
        ("write to jane at mail dot example dot org.", ["jane at mail dot example dot org"]),
        ("call plus one five five five one two three four five six seven today", ["plus one five five five one two three four five six seven"]),
        ("ｊоe＠exаmple。com", ["ｊоe＠exаmple。com"]),
        ("joe​@exam­ple.com!", ["joe​@exam­ple.com"]),
        ("look at the dot on the map at noon", []),
        ("one two three four", []),
    ],
)
def test_disguised_spans_map_back(text, found):
    base, every = pii.find(text)
    assert base == [] and [text[a:b] for a, _, b in every] == found


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("ask john at example.com today", "ask <EMAIL> today"),
        ("ask john at mail.example dot com.", "ask <EMAIL>."),
        ("ask john at example dot xyz today", "ask <EMAIL> today"),
        ("call plus 49 151 1234567 now", "call <PHONE> now"),
        ("call +49 151 one 2 three 4 five 6 seven now", "call <PHONE> now"),
        ("card 4111 1111 one111 1111, 4111 1111 1111 111-one end", "card 4111 1111 one111 1111, <CARD> end"),
        ("card 4111 1111 111 one 1111 end", "card <CARD> end"),
        ("mail john dot smith@example.com now", "mail <EMAIL> now"),
        ("call +49 30 123456 seven eight nine now", "call <PHONE> now"),
        ("call +49 30 1234567. One day at 3.30 we met at noon", "call <PHONE>. One day at 3.30 we met at noon"),
        ("look at the dot is all I ask, at a dot so small", "look at the dot is all I ask, at a dot so small"),
    ],
)
def test_mixed_disguises_are_redacted_whole(text, clean):
    base, every = pii.find(text)
    assert set(base) <= set(every) and pii.redacted(text, every) == clean


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("x " + "0" * 5000 + "1.1.1.1 y", "x <IP> y"),
        ("write to 𝓳𝓸𝓱𝓷@𝕖𝕩𝕒𝕞𝕡𝕝𝕖.com now", "write to <EMAIL> now"),
        ("ⓙⓞⓗⓝ@example.com, հոlly@example.com and ᎪᏞ@example.com", "<EMAIL>, <EMAIL> and <EMAIL>"),
        ("call +४९ 30 1234567 today", "call <PHONE> today"),
        ("john at a.b.c.d.e.f.g.h.example dot com", "<EMAIL>"),
    ],
)
def test_pii_of_other_scripts_and_long_numbers(text, clean):
    assert pii.redacted(text, pii.find(text)[1]) == clean


def test_pii_of_very_many_spans_is_linear():
    text = "john (at) example.com, joe@example.com; " * 20_000
    base, every = pii.find(text)
    assert (len(base), len(every)) == (20_000, 40_000)


def test_pii_rows(docs, empty):
    assert pii.pii_digest(empty).count() == 0
    for r in pii.pii_digest(docs).collect():
        t = dict((i, x or "") for i, x, *_ in TEXTS)[r.doc_id]
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain(t))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    clean = pii.redacted_documents(docs.withColumn("text", F.lit("a joe@x.org b"))).first()
    assert clean.text == "a <EMAIL> b"


def test_bucket_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = np.sort(rng.choice(np.arange(1, 40), 8, replace=False)).astype(np.int64)
        counts, k = rng.integers(1, 9, 8), int(rng.integers(1, 5))
        pad = lambda ends: sum(int(c) * (min(e for e in ends if e >= x) - int(x)) for x, c in zip(lengths, counts, strict=True))  # noqa: E731, B023
        want = min(pad((*some, int(lengths[-1]))) for j in range(k) for some in combinations(map(int, lengths[:-1]), j))
        ends, got = packing.boundaries(lengths, counts, k)
        assert got == want == pad(tuple(ends)) and len(ends) <= k
    assert packing.boundaries(np.zeros(0, np.int64), np.zeros(0, np.int64), 3)[1] == 0


def test_packing_places_every_piece_once(docs, real, empty):
    assert packing.pack(empty).count() == 0
    for table in (docs, real):
        rows = packing.pack(table, max_len=100, n_buckets=4, token_budget=300, shard_rows=7).collect()
        words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in table.collect())
        assert sum(r.length for r in rows) == words and len({r.bucket_len for r in rows}) <= 4
        assert len({(r.bucket_len, r.batch, r.slot) for r in rows}) == len(rows)
        for b in {r.bucket_len for r in rows}:
            own = [r for r in rows if r.bucket_len == b]
            assert sorted(r.batch * max(1, 300 // b) + r.slot for r in own) == list(range(len(own)))
            assert all(0 <= r.padding == b - r.length for r in own)


def brute_repeats(table):
    seen, out = {}, {}
    rows = sorted(((r.doc_id, (r.text or "").encode()) for r in table.collect()), key=lambda x: (x[0] is None, x[0]))
    for i, b in rows:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            seen[w] = min(seen.get(w, (True, 0)), (i is None, i or 0))
    for i, b in rows:
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < (i is None, i or 0):
                gone[k : k + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.setdefault(i, []).append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def repeated_texts(spark):
    """Random texts of few letters that share passages, with repeated rows, equal ids, a null one and the largest one."""
    rng = np.random.default_rng(8)
    letters = np.array(list("ab é"))
    passage = ["".join(letters[rng.integers(0, 4, n)]) for n in (49, 50, 51, 60, 90, 200, 700)]
    rows = []
    for i in range(120):
        parts = ["".join(letters[rng.integers(0, 4, rng.integers(0, 80))]) + passage[rng.integers(0, len(passage))] for _ in range(rng.integers(0, 4))]
        rows.append((int(i), "".join(parts)))
    rows += [(rows[k][0], rows[k][1]) for k in (3, 4)] + [(500 + k, rows[k][1]) for k in range(20)] + [(7, rows[90][1]), (None, passage[5] + "x"), (None, rows[2][1])]
    rows += [((1 << 63) - 1, passage[5] + "x"), (-(1 << 63), passage[6]), (900, None), (901, "ab" * 3000), (902, "b" + "ab" * 3000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_windows_that_cover_nothing_are_not_joined(spark):
    rows = [("alone", 1), ("one id", 2), ("one id", 2), ("two ids", 3), ("two ids", 1), ("no id", None), ("no id", None), ("some id", None), ("some id", 4)]
    got = suffix_dedup.repeated_windows(spark.createDataFrame(rows, "w string, least long")).collect()
    assert sorted((r.w, r.first, r.n) for r in got) == [("some id", 4, 2), ("two ids", 1, 2)]


@pytest.mark.parametrize("way", ["plain", "many tasks", "hot"])
def test_repeats_equal_brute_force(spark, docs, real, monkeypatch, way):
    if way != "plain":
        monkeypatch.setattr(suffix_dedup, "TASK_CONTEXTS", 1)
        monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 5000)
    if way == "hot":  # every anchor goes by the aggregation of its windows
        monkeypatch.setattr(suffix_dedup, "HOT", 0)
    for table in (docs, real.filter("length(text) < 3000"), repeated_texts(spark)):
        got: dict = {}
        for r in suffix_dedup.remove_repeats(table, digest=True).collect():
            got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        assert {k: sorted(v) for k, v in got.items()} == brute_repeats(table)


def test_bytes_left_by_removal(spark):
    table = repeated_texts(spark)
    digests = sorted((r.doc_id or 0, r.kept_sha256) for r in suffix_dedup.remove_repeats(table, digest=True).collect())
    assert sorted((r.doc_id or 0, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(table).collect()) == digests


def test_repeats_of_an_empty_table(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_sort_with_and_without_collisions(monkeypatch):
    rng = np.random.default_rng(4)
    strings = rng.integers(97, 99, (300, 30)).astype(np.uint8)
    segment = rng.integers(0, 7, 300)
    want = sorted(range(300), key=lambda i: (segment[i], strings[i].tobytes()))
    for base in (suffix_dedup._BASE, 1):  # base 1 makes a hash of the bytes' sum: full of collisions
        monkeypatch.setattr(suffix_dedup, "_BASE", base)
        order, common = suffix_dedup.classes(strings, segment)
        assert [(segment[i], strings[i].tobytes()) for i in order] == [(segment[i], strings[i].tobytes()) for i in want]
        for k in range(1, 300):
            a, b = strings[order[k - 1]].tobytes(), strings[order[k]].tobytes()
            n = next((i for i in range(30) if a[i] != b[i]), 30)
            assert common[k] == (-1 if segment[order[k]] != segment[order[k - 1]] else n)


def test_targets_reshare_the_excess():
    t = mixing.capped_targets(np.array([10.0, 100.0, 100.0]), np.array([5.0, 2.0, 1.0]), 315.0, 2.0)
    assert t[0] == 20 and t[1] == pytest.approx(196.6666667) and t.sum() == pytest.approx(315)


def test_fit_reaches_the_best_sum():
    rng = np.random.default_rng(5)
    for _ in range(40):
        sizes = np.sort(rng.choice(np.arange(2, 60), 5, replace=False)).astype(np.int64)
        counts = rng.integers(1, 4, 5).astype(np.int64)
        sums = {0}
        for s, c in zip(sizes, counts, strict=True):
            sums = {x + int(s) * k for x in sums for k in range(int(c) + 1)}
        rest = int(rng.integers(1, int((sizes * counts).sum()) + 1))
        take = mixing.knapsack(sizes, counts, rest)
        assert (take <= counts).all() and int((take * sizes).sum()) == max(x for x in sums if x <= rest)
        assert (mixing.fit(sizes, counts, rest) <= counts).all()


def test_mix_rows(docs, real, empty, monkeypatch):
    assert mixing.mix(empty).count() == 0
    monkeypatch.setattr(mixing, "SHARD_ROWS", 3)
    for table in (docs, real):
        out = mixing.mix(table).collect()
        assert len(out) == table.count() and out and sorted(map(str, out)) == sorted(map(str, mixing.mix(table.repartition(5)).collect()))
        total = sum(r["size"] for r in out)
        per: dict = {}
        for r in out:
            assert r.taken in (0, r["size"], 2 * r["size"])
            x = per.setdefault(r.source, [r.source_size, r.target, 0, 0])
            x[2], x[3] = x[2] + r.taken, x[3] + r["size"]
        assert sum(x[1] for x in per.values()) == pytest.approx(1.5 * total)
        assert all(x[0] == x[3] and x[1] <= 2 * x[0] for x in per.values())
    assert all(abs(x[2] - x[1]) <= max(5, 0.02 * x[1]) for x in per.values())
    again = mixing.mixed_documents(real)
    assert again.columns == real.columns and again.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_mixed_documents_do_not_depend_on_partitions(spark):
    rows = [(i // 2, f"one two three w{i}", "abc"[i % 3]) for i in range(120)] + [(7, "the same five words here", "a")] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = [sorted(map(tuple, mixing.mixed_documents(t).collect())) for t in (table.coalesce(1), table.repartition(7), table.orderBy(F.desc("text")))]
    assert taken[0] == taken[1] == taken[2] and 0 < len(set(taken[0])) < len(set(rows))


def test_pipeline_stages(spark, docs, real):
    import corpus_pipeline

    table = real
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, "")
        assert table.columns == real.columns, name
    assert table.count() > 0
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, odd, "").collect()}
    assert not kept & {5, 6, 7}
    assert corpus_pipeline.near_duplicate_stage(spark, odd, "").filter("doc_id IN (2, 4)").count() == 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_fit_equals_brute_force_whatever_the_window(monkeypatch):
    rng = np.random.default_rng(11)
    for window in (1 << 17, 16):
        monkeypatch.setattr(mixing, "WINDOW", window)
        for _ in range(300):
            k = int(rng.integers(1, 7))
            sizes, counts = rng.choice(np.arange(1, 80), k, replace=False).astype(np.int64) * int(rng.choice([1, 3])), rng.integers(0, 5, k)
            sums = {0}
            for s, c in zip(sizes, counts, strict=True):
                sums = {x + int(s) * j for x in sums for j in range(int(c) + 1)}
            rest = int(rng.integers(0, int((sizes * counts).sum()) + 5))
            take = mixing.fit(sizes, counts, rest)
            assert (take <= counts).all() and (take >= 0).all() and int((take * sizes).sum()) == max(x for x in sums if x <= rest)
    assert mixing.fit(np.array([3, 5]), np.array([2, 2]), 10).tolist() == [0, 2]


def test_language_needs_a_letter():
    model = lang_id.Model({"en": [BASE], "fr": ["été déjà vu et le reste"]})
    told = [p for p, _ in model.predict(["½ ²", "Ⅷ ① 42", "___ 12", "ª", "漢", "a", None, ""])]
    assert told[:3] == ["und"] * 3 and told[6:] == ["und"] * 2 and all(x != "und" for x in told[3:6])


def test_language_of_many_texts_is_that_of_each():
    model = lang_id.Model({"en": [BASE], "fr": ["été déjà vu et le reste"]})
    texts = [BASE, None, "été " * 50, "", "the dog", "vu " * 99]
    each = [r for t in texts for r in model.predict([t])]
    assert [(p, pytest.approx(s)) for p, s in model.predict(texts)] == each


def test_near_duplicates_of_one_set_in_another_order(spark):
    words = [f"w{i % 7}" for i in range(30)]
    turned = words[2:] + words[:2]  # the same two-word shingles in another order
    rows = [(1, " ".join(words)), (2, " ".join(turned)), (3, " ".join(words).upper()), (4, "other words here")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), w=2).collect()}
    assert got == {1: (7, 1), 2: (7, 1), 3: (7, 1), 4: (2, 4)}


def test_sketches_do_not_depend_on_how_sets_are_dealt(spark, real, monkeypatch):
    rows = real.limit(60).selectExpr("doc_id AS id", "text")
    one = {r.id: (r.n, r.bands, r.bits) for r in near_dup.sketched(rows, 5, 200, 40).collect()}
    monkeypatch.setattr(near_dup, "DEALT", 3000)
    assert {r.id: (r.n, r.bands, r.bits) for r in near_dup.sketched(rows, 5, 200, 40).collect()} == one


def test_pipeline_stages_on_an_empty_table_and_clashing_names(spark, empty):
    import corpus_pipeline

    names = ["prediction", "mix_row", "mix_times", "mix_copy", "id", "size", "node", "Label", "lang_pred", "score", "rows", "band", "whole", "taken", "key"]
    wide = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    wide = wide.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    table = wide
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        assert stage(spark, wide.limit(0), "").count() == 0, name
        table = stage(spark, table, "")
        if name != "packing":
            assert table.columns == wide.columns, name
    assert table.count() > 0
