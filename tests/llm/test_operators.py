"""Each operator against brute force, a published library or held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import regex
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliolens.llm import (
    components,
    graph_ann,
    language_id,
    licence_rules,
    packing,
    pii,
    piece_fst,
    quality_rules,
    queries,
    secret_scan,
    simhash_vp,
    vector_dedup,
)
from foliolens.llm.common import table

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF01, "documents").toPandas()


def _random_texts(n: int, alphabet: str, longest: int, seed: int = 0) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(n)]


# Op 1.
def test_quality_held_out_accuracy(spark):
    got = queries.op1_quality(spark, SF01).join(table(spark, SF01, "labels"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() >= 0.97
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_rule_columns_agree_with_rows(spark):
    docs = table(spark, SF01, "documents").select("doc_id", "text")
    model = quality_rules.fit_quality(docs, table(spark, SF01, "labels"))
    assert 0 < len(model.rules) < 200
    rows = quality_rules.with_statistics(docs).withColumn("score", model.score()).select("score", "_statistics.*").toPandas()
    assert np.allclose(model.score_rows(rows[list(quality_rules.STATISTICS)].to_numpy(float)), rows.score)


def test_quality_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality_rules.with_quality(docs, quality_rules.fit_quality(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id bigint, quality int")
    assert all(r["score"] > 0.9 for r in quality_rules.with_quality(docs, quality_rules.fit_quality(docs, ones)).collect())


# Op 2.
def test_nearest_recall_and_scores(spark):
    got = queries.op2_nearest(spark, SF01).toPandas()
    rows = table(spark, SF01, "embeddings").toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    hits = []
    for q, own in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        assert np.allclose(own.sort_values("rank").score, [d[ids == v][0] for v in own.sort_values("rank").vec_id], atol=0)
        d[ids == q] = np.inf
        hits.append(len(set(ids[np.lexsort((ids, d))[:10]]) & set(own.vec_id)) / 10)
        assert own.sort_values("rank").score.is_monotonic_increasing and q not in set(own.vec_id)
    assert len(hits) == 5 and np.mean(hits) >= 0.9


def test_nearest_with_copies_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 40)] + [(100, [5.0, 5.0]), (101, None), (102, [0.0, 0.0]), (103, [float("nan"), 1.0]), (104, [None, 1.0]), (105, []), (None, [1.0, 1.0]), (106, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, score string")
    got = graph_ann.nearest(df, df.where("vec_id in (0, 100, 101, 106)"), k=10, shard_rows=16).toPandas()
    assert list(got[got.query_id == 0].sort_values("rank").vec_id) == list(range(1, 11))
    assert list(got[got.query_id == 100].sort_values("rank").vec_id) == list(range(0, 10))
    assert set(got.query_id) == {0, 100}
    empty = df.where("false")
    assert graph_ann.nearest(empty, empty).count() == 0


# Op 3.
def test_pieces_equal_the_library(documents):
    fst, library = piece_fst.transducer(piece_fst.default_model()), sentencepiece.SentencePieceProcessor(model_file=piece_fst.default_model())
    texts = [t for t in documents.text if t][:300] + _random_texts(3000, "ab the\n\t  ▁中😀é́_-.<0x41>&ɏ\x00", 25)
    for text in [*texts, "", " ", "     ", "a" * 3000, "▁▁ x"]:
        ids = fst.encode(text)
        assert ids == library.encode(text)
        assert fst.decode(ids) == library.decode(ids)


def test_score_model_takes_the_best_path():
    fst = piece_fst.PieceTransducer(piece_fst.default_model())
    fst.merges, fst.arcs, fst.lengths = False, {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}, [1, 2, 3]
    fst.weights = [3.0, 3.0, 2.0, 1.0, 9.0]
    assert fst.shortest_path("aba") == ["a", "ba"]
    assert fst.shortest_path("ab?") == ["ab", "?"]


def test_encode_then_decode_frames(spark):
    docs = spark.createDataFrame([(1, "Ein  Text\nmit 😀"), (2, None), (3, "")], "doc_id bigint, text string")
    back = {r["doc_id"]: r["text"] for r in piece_fst.decode(piece_fst.encode(docs)).collect()}
    assert back == {1: "Ein  Text\nmit 😀", 2: "", 3: ""}


# Op 4.
def _base_secrets(text: str) -> list[tuple[str, int, int]]:
    rules = [
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    found = [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m)]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets_equal_plain_patterns(spark, documents):
    made = _random_texts(4000, "", 0) or []
    rng = random.Random(3)
    parts = ["password", "Token", "SECRET", "api_key", "apiKEY", "passwd", "=", ":", " ", '"', "'", "abcdef", "0123456789abcdef" * 2, "AKIA", "ABCDEFGHIJ234567", "ß", "İ", "K", "ſecret", "\n", "x.y/z"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)]
    for text in [*(t for t in documents.text if t), *made]:
        assert [s for s in secret_scan.find_secrets(text) if s[0] in secret_scan.BASE_KINDS] == _base_secrets(text)
    got = {r["doc_id"]: r for r in queries.op4_secrets(spark, SF01).collect()}
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in _base_secrets(text or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_checksums_decide(spark):
    body = "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9cD1"
    good = f"ghp_{body}{secret_scan.base62_crc32(body)}"
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert ("github", 2, 42) in secret_scan.find_secrets(f"x {good} y")
    assert not any(s[0] == "github" for s in secret_scan.find_secrets(f"x {bad} y"))
    assert secret_scan.redacted("a password=abcdef1 b", secret_scan.find_secrets("a password=abcdef1 b")) == "a [SECRET] b"


def test_private_keys_are_whole_with_header_lines():
    body = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C3D\n\nMIIEow+/IBAAKCAQ==\nq83vEjRWeJA=\n"
    for inner, end in ((body, "-----END RSA PRIVATE KEY-----"), (body.replace("\n", "\\n"), "-----END RSA PRIVATE KEY-----"), (body.replace("\n", " "), "-----END RSA PRIVATE KEY-----"), (body.strip(), "")):
        key = f"-----BEGIN RSA PRIVATE KEY-----\n{inner}{end}"
        text = f"a {key}"
        assert ("private_key", 2, len(text)) in secret_scan.find_secrets(text)
        if end:
            assert secret_scan.redacted(f"{text} b", [s for s in secret_scan.find_secrets(f"{text} b") if s[0] == "private_key"]) == "a [SECRET] b"
    assert len(secret_scan.find_secrets("-----BEGIN PRIVATE KEY-----a" * 20_000)) == 20_000


# Op 5.
def _base_pii(text: str) -> list[tuple[str, int, int]]:
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn_holds(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    found = [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]
    return sorted(found, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def test_pii_equals_plain_patterns(documents):
    rng = random.Random(4)
    parts = ["a.b", "@", "mail.example.com", ".", "-", " ", "+", "1", "23", "456", "4111111111111111", "(555)", "255.1.2.3", "٣", "\n", "x"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 16))) for _ in range(6000)]
    for text in [*(t for t in documents.text if t), *made]:
        assert [s[:3] for s in pii.find_pii(text) if s[0] in pii.BASE_KINDS] == _base_pii(text)


def test_pii_checksums_and_context():
    assert pii.mod97_holds("GB82WEST12345698765432") and not pii.mod97_holds("GB82WEST12345698765431")
    assert any(s[0] == "iban" for s in pii.find_pii("iban GB82 WEST 1234 5698 7654 32."))
    assert not pii.find_pii("number 123-45-6789") and pii.find_pii("SSN 123-45-6789")[0][0] == "ssn"
    near, far = pii.find_pii("call +1 (988) 555-2485")[0], pii.find_pii("take +1 (988) 555-2485")[0]
    assert near[3] > far[3]
    assert len(pii.find_pii("1" * 200_000 + "@" * 1000 + "a" * 200_000)) == 0


def test_account_numbers_before_and_after_other_words():
    number = "DE89 3704 0044 0532 0130 00"
    for before, after in (("IBAN ", " BIC COBADEFFXXX"), ("", " BIC"), ("IBAN ", ", BIC COBADEFFXXX"), ("AB12 ", " X"), ("", " Bank"), ("", " 12 34"), ("", "")):
        text = before + number + after
        assert [s[:3] for s in pii.find_pii(text) if s[0] == "iban"] == [("iban", len(before), len(before) + len(number))]
    assert not [s for s in pii.find_pii(f"{number}1 {number}x x{number} {number[:-1]}") if s[0] == "iban"]
    assert [s[1] for s in pii.find_pii(f"{number} {number}") if s[0] == "iban"] == [0, len(number) + 1]


# Op 6.
def _brute_links(x: np.ndarray) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    return links


def test_vector_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16))
    x = np.concatenate((x, x[:80] + 0.05 * rng.standard_normal((80, 16)), x[:20], np.repeat(x[7:8], 60, axis=0)))
    ids = rng.permutation(len(x)) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>")
    got = vector_dedup.near_duplicates(df).toPandas().set_index("vec_id").loc[ids]
    links = _brute_links(x)
    assert (got.n_links.to_numpy() == links.sum(axis=1)).mean() > 0.99
    i, j = np.nonzero(links)
    order = np.argsort(ids)
    place = np.argsort(order)
    labels = components.local_labels(len(x), place[i], place[j])
    assert (got.component_id.to_numpy() == ids[order][labels[place]]).mean() > 0.99
    assert (got.kept == (got.index == got.component_id)).all()


def test_chunked_buckets_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CHUNKED_ROWS", 40)
    rng = np.random.default_rng(6)
    x = np.ones((150, 8)) + 0.02 * rng.standard_normal((150, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = vector_dedup.near_duplicates(df).toPandas()
    assert (got.n_links == 149).all() and (got.component_id == 0).all()


def test_vectors_that_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("inf"), 1.0]), (5, []), (6, [2.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id bigint, embedding array<float>, n_links int")
    got = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(df).collect())
    assert got == [(-1, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 2, 1, False), (7, 0, 7, True)]
    assert vector_dedup.near_duplicates(df.where("false")).count() == 0


# Op 7.
def test_licence_rules():
    assert licence_rules.find_licences("Text.\nReleased under the MIT License.\nMore.")[0][:3] == ("MIT", 6, 6 + len("Released under the MIT License."))
    bsd = "\n".join(licence_rules.SENTENCES[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"))
    assert [x[0] for x in licence_rules.find_licences(bsd)] == ["BSD-3-Clause"]
    assert [x[0] for x in licence_rules.find_licences(bsd.rsplit("\n", 1)[0])] == ["BSD-2-Clause"]
    wrapped = licence_rules.SENTENCES["mit-grant"][0].replace(" copy,", "\ncopy,").replace("without limitation", "without\nlimitation").upper()
    assert [x[0] for x in licence_rules.find_licences(f"Copyright (c) me\n{wrapped}\n\n" + licence_rules.SENTENCES["mit-notice"][0])] == ["MIT"]
    both = "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."
    assert [x[0] for x in licence_rules.find_licences(both)] == ["CC-BY-NC-4.0", "Apache-2.0"]
    assert licence_rules.find_licences(None) == licence_rules.find_licences("") == licence_rules.find_licences("a licence to nothing.") == []


def test_licences_of_all_documents(spark, documents):
    got = {r["doc_id"]: r["n_matches"] for r in queries.op7_licences(spark, SF01).collect()}
    wanted = re.compile(r"^(?:Released under the MIT License\.|This work is licensed under the GNU General Public License, version 3\.|Licensed under the Apache License, Version 2\.0\.|Licensed under CC BY-NC 4\.0\.)$", re.M)
    assert got == {i: len(wanted.findall(t or "")) for i, t in zip(documents.doc_id, documents.text, strict=True)}


def test_known_sentences_wrapped_over_many_lines():
    import textwrap

    for key, texts in licence_rules.SENTENCES.items():
        for width in (20, 35):
            text = textwrap.fill(texts[0], width, break_long_words=False, break_on_hyphens=False).replace("\n", "\n * ")
            assert [s for s in licence_rules.licence_sentences(text) if s[0]] == [(key, 0, len(text))]
    mit = "\n--\n".join(textwrap.fill(licence_rules.SENTENCES[k][0], 30) for k in ("mit-grant", "mit-notice", "mit-warranty"))
    assert licence_rules.find_licences(mit) == [("MIT", 0, len(mit), ("mit-grant", "mit-notice", "mit-warranty"))]


# Op 8.
def _brute_fingerprint(text: str | None) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_equal_brute_force(documents):
    for text in [*documents.text[:60], None, "", " \t", "One", "one TWO", "É Ab\x1cc d\xa0e f", *_random_texts(200, "aB cD\n\tß ", 60)]:
        assert simhash_vp.fingerprint(text) == _brute_fingerprint(text)


@pytest.mark.parametrize("shard_rows", [50, 16_384])
def test_vantage_trees_lose_no_pair(shard_rows, monkeypatch):
    monkeypatch.setattr(simhash_vp, "BLOCK", 400)
    rng = np.random.default_rng(shard_rows)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = base[:200].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
    hot = np.repeat(base[:1], 150) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    fps = np.unique(np.concatenate((base, near, hot))).view(np.int64)
    reps = rng.permutation(len(fps)).astype(np.int64)
    levels = max(0, int(np.ceil(np.log2(len(fps) / shard_rows))))
    a, b = [], []
    for t in (0, 1):
        tree = simhash_vp.VantageTree.fit(fps, t, levels)
        row, shard, home = tree.route(fps)
        assert np.bincount(row[home], minlength=len(fps)).tolist() == [1] * len(fps)
        for s in np.unique(shard):
            own = shard == s
            x, y = simhash_vp.shard_links(fps[row[own]], reps[row[own]], home[own], t)
            a.append(x)
            b.append(y)
    got = components.local_labels(len(fps), np.concatenate(a), np.concatenate(b))
    u = fps.view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)
    assert (got == components.local_labels(len(fps), reps[i], reps[j])).all()


def test_simhash_groups_equal_brute_force(spark, documents):
    got = queries.op8_simhash(spark, SF01).toPandas()
    x = np.array([int(v, 16) for v in got.fingerprint], dtype=np.uint64)
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    order = np.argsort(got.doc_id.to_numpy())
    place = np.argsort(order)
    labels = components.local_labels(len(x), place[i], place[j])
    assert (got.component_id.to_numpy() == got.doc_id.to_numpy()[order][labels[place]]).all()


def test_components_of_paths_stars_and_cycles(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(1000, k) for k in range(1001, 1100)] + [(1100, 1050), (5, 5), (None, 3)]
    rng = random.Random(0)
    edges += [(2000 + i, 2000 + (i + 1) % 20) for i in range(20)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {k: 1000 for k in range(1001, 1101)} | {2000 + i: 2000 for i in range(1, 20)}


def test_one_of_each_group(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, "quite another text here"), (3, "quite another text here"), (None, "a b c d"), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, component_id string")
    got = simhash_vp.one_of_each_group(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got.collect()) == [-1, 1, 3, 4]


# Op 9.
def test_language_held_out_accuracy(spark):
    got = queries.op9_language(spark, SF01).join(table(spark, SF01, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.98 and got.score.between(0, 1).all()


def test_ranked_ngrams_equal_brute_force():
    for text in ["Das Haus, das 3 Häuser!", "a", "x y", "--", " Äb\ncd "]:
        words = [w.lower() for w in regex.findall(r"\p{L}+", text)]
        grams: dict[str, int] = {}
        for w in words:
            for n in (1, 2, 3):
                padded = w if n == 1 else f" {w} "
                for i in range(len(padded) - n + 1):
                    grams[padded[i : i + n]] = grams.get(padded[i : i + n], 0) + 1
        keys, counts = language_id.ranked_ngrams(text, 1000)
        texts = []
        for k in keys.tolist():
            part = ""
            while k:
                part = chr(k & 0x1FFFFF) + part
                k >>= 21
            texts.append(part)
        assert dict(zip(texts, counts.tolist(), strict=True)) == grams


def test_language_unknown(spark):
    docs = spark.createDataFrame([(1, "der und die", "de"), (2, None, "de"), (3, "", None), (4, "12 !!", "fr"), (5, "le et la", "fr")], "doc_id bigint, text string, lang string")
    profiles = language_id.fit_profiles(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.with_language(docs, profiles).collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0)
    assert profiles.predict("x")[0] in {"de", "fr", "und"}
    empty = language_id.fit_profiles(docs.where("false"))
    assert {r["lang_pred"] for r in language_id.with_language(docs, empty).collect()} == {"und"}


# Op 10.
def _check_packing(got: pd.DataFrame, texts: dict[int, str | None]) -> None:
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    tokenizer.encode_special_tokens = True
    for i, own in got.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in own.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids)) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    ends = []
    for _, own in by:
        at = 0
        for r in own.itertuples():
            assert r.offset == at
            at += r.length
        ends.append(at)
    assert all(e == packing.WINDOW for e in ends[:-1]) and list(by.groups) == list(range(len(ends)))


def test_packing_round_trip(spark, documents):
    few = table(spark, SF01, "documents").where("doc_id < 150").repartition(3)
    got = packing.pack(few).toPandas()
    assert set(got.doc_id) == set(range(150))
    _check_packing(got, dict(zip(documents.doc_id, documents.text, strict=True)))


def test_packing_null_empty_special_and_long(spark):
    texts = {1: None, 2: "", 3: "<|endoftext|> x", 4: "word " * 30_000, 5: "a" * 20_000}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id bigint, text string, ids int")
    got = packing.pack(df, keep_ids=True).toPandas()
    _check_packing(got, texts)
    assert all(len(r.ids) == r.length for r in got.itertuples())
    assert packing.pack(df.where("false")).count() == 0


def test_word_encoder_equals_the_library():
    encoder, tokenizer = packing.encoder(packing.default_vocabulary()), Tokenizer.from_file(packing.default_vocabulary())
    tokenizer.encode_special_tokens = True
    texts = _random_texts(4000, "ab 'streLL\n\t  12²½éß\x1c\x85\xa0 中😀_-.&ɏœªΏ", 30)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# All.
HARD = [(1, None), (2, ""), (3, "x" * 200_000), (4, "the same text of a few words"), (4, "the same text of a few words"), (5, "the same text of a few words"), (None, "no id"), (6, "ab " * 60_000), (7, "\x00퟿ é 😀  ")]


@pytest.mark.parametrize("name", ["quality", "pieces", "secrets", "pii", "licences", "simhash", "language", "packing"])
@pytest.mark.parametrize("empty", [False, True])
def test_hard_rows_and_clashing_columns(spark, name, empty):
    extra = "score string, lang_pred string, fp string, component_id string, secrets string, pii string, licences string, ids string, part string, n string, lang string, _statistics string"
    count = len(extra.split(","))
    df = spark.createDataFrame([(*r, *["z"] * count) for r in ([] if empty else HARD)], f"doc_id bigint, text string, {extra}")
    run = {
        "quality": lambda: quality_rules.with_quality(df, quality_rules.fit_quality(df, spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id bigint, quality int"))),
        "pieces": lambda: piece_fst.digest(df),
        "secrets": lambda: secret_scan.scan_secrets(df),
        "pii": lambda: pii.scan_pii(df),
        "licences": lambda: licence_rules.scan_licences(df),
        "simhash": lambda: simhash_vp.near_duplicates(df),
        "language": lambda: language_id.with_language(df, language_id.fit_profiles(df)),
        "packing": lambda: packing.pack(df).select("doc_id", "sequence_id", "offset", "length").groupBy("doc_id", "sequence_id", "offset").agg(F.max("length").alias("n")).groupBy("doc_id").count(),
    }[name]()
    rows = run.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == (set() if empty else {r[0] for r in HARD})
    else:
        assert len(rows) == (0 if empty else len(HARD))
