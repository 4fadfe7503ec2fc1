"""Operators 3, 5, 6 and 9: brute force, round trips and held-out accuracy."""

import collections
import re

import numpy as np

from tessera.llm import audio, langid, licenses, toxicity
from tessera.llm.queries import op3_license_scan, op5_chroma_fingerprints, op6_language_id, op9_toxicity

SF = "/root/testdata/sf0.01"


# --- licences -----------------------------------------------------------------------------------


def canonical(text):
    out = re.sub(r"(?m)^[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*$", "", text.lower())
    for a, b in licenses.SAME:
        out = out.replace(a, b)
    return re.sub("[^a-z0-9]+", " ", out).strip()


def scanned(doc_id, text):
    known = {}
    for name, t in licenses.KNOWN:
        known.setdefault(canonical(t), name)
    if text is None:
        return
    units = [("document", text), *(("paragraph", p) for p in re.split("\n[ \t]*\n", text)), *(("line", x) for x in text.split("\n"))]
    for unit, t in units:
        if canonical(t) in known:
            yield doc_id, known[canonical(t)], unit


def test_license_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = collections.Counter(x for d in docs for x in scanned(d.doc_id, d.text))
    assert {(r.doc_id, r.license, r.unit): r.n for r in op3_license_scan(spark, SF).collect()} == dict(want)


def test_license_forms(spark):
    mit = licenses.KNOWN[0][1]
    texts = ["Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " , "), "intro\n\n" + mit.replace("\n", " ") + "\n\nafter", mit + " and more", None, "", "Released under the MIT Licence!", "All rights reserved."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {(r.doc_id, r.unit) for r in licenses.scan(df).collect() if r.license == "MIT"}
    assert got == {(0, "document"), (0, "paragraph"), (1, "paragraph"), (1, "line"), (5, "document"), (5, "paragraph"), (5, "line")}
    assert licenses.scan(df.where("false")).count() == 0


def test_license_whole_texts(spark):
    """Whole licences as they stand in files: under a title, with blank lines, wrapped, and inside longer documents."""
    import textwrap

    mit = "\n\n".join(textwrap.fill(x, 76) for x in licenses.KNOWN[0][1].split("\n"))
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.

""" + textwrap.fill(licenses._BSD.rsplit("\n", 1)[1].replace("{2}", ""), 78)
    apache, gpl = ((licenses.TEXTS / f"{n}.txt").read_text() for n in ("Apache-2.0", "GPL-3.0-only"))
    texts = {
        1: "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + mit,
        2: "Read me.\n\nThe MIT License (MIT)\n\n" + mit + "\n\nBye.",
        3: "BSD 3-Clause License\n\nCopyright (c) 2019, A\nAll rights reserved.\n\n" + bsd,
        4: "intro\n\n" + bsd + "\n\n" + mit,
        5: apache,
        6: "Before it.\n\n" + apache.split("APPENDIX")[0] + "\n\nAfter it.",
        7: gpl,
        8: gpl.replace("modify", "sell", 1),
        9: "MIT License",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.license, r.unit): r.n for r in licenses.scan(df).collect()}
    assert {k for k in got if k[2] == "document"} == {(1, "MIT", "document"), (3, "BSD-3-Clause", "document"), (5, "Apache-2.0", "document"), (7, "GPL-3.0-only", "document")}
    inside = {k[:2]: n for k, n in got.items() if k[2] == "paragraphs"}
    assert inside[2, "MIT"] == 2  # with its title and without
    assert inside[4, "BSD-3-Clause"] == inside[4, "MIT"] == 1 and inside[6, "Apache-2.0"] >= 1
    assert not [k for k in got if k[0] in (8, 9)]


def test_license_repeats_and_clashes(spark):
    """Repeated rows add up, other columns are not looked at, and a very long text is scanned whole."""
    mit = licenses.KNOWN[0][1].replace("\n", " ")
    rows = [(1, mit, "x", 1)] * 3 + [(2, "word " * 60_000 + "\n\n" + mit, "x", 1)]
    got = {(r.doc_id, r.unit): r.n for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, unit string, n int")).collect() if r.license == "MIT"}
    assert got[1, "document"] == 3 and got[2, "paragraph"] == 1


# --- audio --------------------------------------------------------------------------------------


def tune(seed, notes=60, rate=8000):
    rng = np.random.default_rng(seed)
    t = np.arange(1200) / rate
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (p / 12) * t) * np.hanning(1200) for p in rng.integers(0, 24, notes)]) * 9000


def brute_links(prints, every, votes, errors):
    """Every link by trying all offsets of all pairs, bit by bit."""
    out = {}
    new = {k: np.array([i == 0 or fp[i] != fp[i - 1] for i in range(len(fp))], bool) for k, fp in prints.items()}
    for q_id, q in prints.items():
        if q_id % every:
            continue
        for x_id, x in prints.items():
            best = None
            i, j = np.nonzero((q[:, None] == x[None, :]) & new[q_id][:, None] & new[x_id][None, :])
            for o in np.flatnonzero(np.bincount(j - i + len(q), minlength=1) >= votes) - len(q):
                lo, hi = max(0, -o), min(len(q), len(x) - o)
                a, b = q[lo:hi], x[lo + o : hi + o]
                wrong = sum(bin(int(v)).count("1") for v in a ^ b) / (32 * len(a))
                best = min(best or (2.0, 0), (wrong, int(o)))
            if x_id != q_id and best and best[0] <= errors:
                out.setdefault(x_id, []).append((best[0], q_id, best[1]))
    return {x: (len(v), *min(v)) for x, v in out.items()}


def held_against_brute(spark, df, got, every, decode=audio.pcm, columns=("samples", "rate"), errors=0.30):
    prints = {r.media_id: np.frombuffer(bytes(r.fp), "<u4") for r in audio.fingerprints(df, columns, decode).collect()}
    assert set(got) == set(prints)
    first = {}
    for i in sorted(prints):
        if len(prints[i]):
            first.setdefault(prints[i].tobytes(), i)
    classes = {i: first.get(fp.tobytes(), i) for i, fp in prints.items()}
    asked = {classes[i] for i in prints if i % every == 0 and len(prints[i])}
    # a class is asked if any of its members is: number the classes so that exactly those divide by 2
    names = {c: 2 * c + (c not in asked) for c in set(classes.values())}
    back = {v: k for k, v in names.items()}
    want = brute_links({names[c]: prints[c] for c in names}, 2, 4, errors)
    for i, r in got.items():
        n, error, q, o = want.get(names[classes[i]], (0, None, None, None))
        assert (r.class_id, r.n_frames, r.n_links, r.best_class, r.best_offset) == (classes[i], len(prints[i]), n, back.get(q), o), i
        assert r.best_error == (None if error is None else round(error, 6))
    return want


def test_alignment(spark):
    a, b = tune(1), tune(2)
    rng = np.random.default_rng(0)
    shift = audio.STEP * 20
    still = np.zeros(20 * 8000)
    sounds = {
        100: a, 1: a, 2: a + rng.normal(0, 150, len(a)), 3: np.concatenate([np.zeros(shift), a]), 4: a[shift:], 200: b, 5: tune(3), 6: np.zeros(0), 8: np.zeros(30_000), 9: np.zeros(30_000),
        300: np.concatenate([still[: audio.STEP * 500], tune(7)]), 301: np.concatenate([tune(7), still[: audio.STEP * 500]]),
    }
    rows = [(i, x.astype("<i2").tobytes(), 8000, 0) for i, x in sounds.items()] + [(7, None, 8000, 0), (10, b"abc", None, 0), (1, a.astype("<i2").tobytes(), 8000, 5)]
    df = spark.createDataFrame(rows, "media_id long, samples binary, rate int, fp int")
    out = audio.align(audio.fingerprints(df)).collect()
    got = {r.media_id: r for r in out}
    assert len(out) == len(rows) and [r for r in out if r.media_id == 1][0] == [r for r in out if r.media_id == 1][1]
    assert got[1].class_id == got[100].class_id == 1 and got[8].class_id == got[9].class_id == 8
    for i, offset in ((2, 0), (3, 20), (4, -20)):
        assert (got[i].best_class, got[i].best_offset) == (1, offset) and got[i].best_error < 0.2
    assert [got[i].n_links for i in (5, 6, 7, 8, 10, 200)] == [0] * 6
    # silence at different places doesn't hide where the tunes meet, nor takes their place
    assert got[301].best_class == 300 and got[301].best_offset == -500 and got[301].best_error < 0.1
    held_against_brute(spark, df.dropDuplicates(["media_id"]), got, 100)
    assert audio.align(audio.fingerprints(df.where("false"))).count() == 0


def test_alignment_in_blocks(spark):
    """Blocks of queries, and recordings whose votes are too many to be listed, change nothing."""
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 6, 300).astype("<u4") for _ in range(4)]
    prints = [(i, np.concatenate([base[i % 4][i:], base[(i + 1) % 4][: 2 * i]]).tobytes()) for i in range(12)]
    df = spark.createDataFrame([(i, bytearray(fp), bytearray(str(i).encode())) for i, fp in prints], "media_id long, fp binary, k binary")
    whole = sorted(audio.align(df, every=2).collect())
    assert whole == sorted(audio.align(df, every=2, block=1500).collect()) and sum(r.n_links for r in whole)
    fps = {i: np.frombuffer(fp, "<u4") for i, fp in prints}
    want = brute_links(fps, 2, 4, 0.30)
    assert {r.media_id: (r.n_links, r.best_class, r.best_offset) for r in whole if r.n_links} == {x: (n, q, o) for x, (n, _, q, o) in want.items()}
    for q, x in ((0, 1), (3, 7)):
        s, t = audio.starts(fps[q]), audio.starts(fps[x])
        by_list = audio.offset_votes(s, fps[q][s], t, fps[x][t])
        by_sum = audio.offset_votes(s, fps[q][s], t, fps[x][t], listed=0)
        assert all((u == v).all() for u, v in zip(by_list, by_sum, strict=True))
        block = audio.Queries([q], [fps[q].tobytes()])
        want = by_list[0][by_list[1] >= 4]
        assert block.candidates(fps[x], 4)[1].tolist() == want.tolist() == block._of_pair(0, t, fps[x][t], 4).tolist()


def test_audio_whole_table(spark):
    """Every class, link, offset and error of the query, both ways, over the whole table; and again with links that random tunes have."""
    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "media_id")
    held_against_brute(spark, df, {r.media_id: r for r in op5_chroma_fingerprints(spark, sf).collect()}, 100, audio.played, ("embedding",))
    loose = audio.align(audio.fingerprints(df, ("embedding",), audio.played), every=10, errors=0.45)
    assert held_against_brute(spark, df, {r.media_id: r for r in loose.collect()}, 10, audio.played, ("embedding",), 0.45)


# --- models -------------------------------------------------------------------------------------


def test_language_held_out(spark):
    rows = {r.doc_id: r for r in op6_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = [(rows[d.doc_id].lang_pred, d.lang) for d in docs if rows[d.doc_id].held_out and d.lang]
    assert len(rows) == len(docs) and sum(a == b for a, b in held) / len(held) > 0.98
    assert sum(r.rejected for r in rows.values()) < 0.02 * len(rows)


def test_language_odd_rows(spark):
    train = [(i, " ".join(w + str(i % 3) for w in words) * 9, lang) for lang, words in (("xx", ("abc", "bca", "cab")), ("yy", ("zwv", "vzw", "wvz"))) for i in range(12)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.fit(df)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "123 !?", "a"), (4, "ABC bca " * 5000, "a"), (5, "漢字 кириллица", "a")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "xx"] and not got[4].rejected and got[5].rejected
    assert langid.identify(odd, langid.fit(df.where("false"))).where("lang_pred = 'und'").count() == 5
    assert langid.identify(odd.where("false"), model).count() == 0


def test_language_repeats_and_brute_force(spark):
    """Every prediction is that of the greatest cosine by plain loops; repeated rows agree, and so do reruns."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model, again = langid.fit(docs), langid.fit(docs.repartition(3))
    assert np.array_equal(model.centroids, again.centroids)
    rows = langid.identify(docs.unionByName(docs).withColumn("cosine", docs["lang"]), model).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for r in rows:
        assert seen.setdefault(r.doc_id, r) == r
    for i, r in list(seen.items())[:60]:
        raw = langid.counts(texts[i])
        if raw is None:
            assert r.lang_pred == "und"
            continue
        v = langid.vectors(raw[None, :].astype(np.float32), model.idf)[0]
        cos = [(sum(float(a) * float(b) for a, b in zip(v, c, strict=True) if a), -int(k)) for c, k in zip(model.centroids, model.of, strict=True)]
        best, k = max(cos)
        assert r.lang_pred == model.langs[-k] or abs(sorted(cos)[-2][0] - best) < 1e-5
        assert abs(r.cosine - best) < 1e-4


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op9_toxicity(spark, sf).collect()}
    labels = [(rows[r.doc_id], r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in rows]
    held = [(r.predicted, y) for r, y in labels if r.held_out]
    hits = sum(p and y for p, y in held)
    assert all(0 <= r.score <= 1 for r in rows.values())
    precision, recall = hits / max(1, sum(p for p, _ in held)), hits / sum(y for _, y in held)
    print("toxicity, held out: precision", precision, "recall", recall)
    assert precision > 0.85 and recall > 0.7


def test_pu_risk_and_gradients():
    """Both parts of the risk equal sums over rows, and their gradients small differences."""
    rng = np.random.default_rng(3)
    pos, mix = ([np.unique(rng.integers(0, 6, 3)).astype(np.int32) for _ in range(n)] for n in (7, 20))
    w, prior = rng.normal(size=7), 0.3
    margin = lambda rows, w: np.array([sum(w[f] for f in r) + w[-1] for r in rows])
    loss = lambda z, y: float(np.log1p(np.exp(-z if y else z)))

    def brute(w):
        zp, zu = margin(pos, w), margin(mix, w)
        one = prior * sum(loss(z, 1) for z in zp) / len(zp)
        return one, sum(loss(z, 0) for z in zu) / len(zu) - prior * sum(loss(z, 0) for z in zp) / len(zp)

    assert np.allclose(toxicity.pu_risk(margin(pos, w), margin(mix, w), prior), brute(w))
    flat = [(np.repeat(np.arange(len(x)), [len(r) for r in x]), np.concatenate(x)) for x in (pos, mix)]
    for part, g in enumerate(toxicity.pu_gradients(flat, margin(pos, w), margin(mix, w), 6, prior)):
        for i in range(7):
            step = np.eye(7)[i] * 1e-6
            assert abs((brute(w + step)[part] - brute(w - step)[part]) / 2e-6 - g[i]) < 1e-6


def test_correction_matters():
    """Of a mixture in which two in five are toxic, plain learning from it as negatives finds few; the corrected risk finds them, and stays above 0 where rare features would let it fall."""
    rng = np.random.default_rng(5)
    text = lambda toxic: np.unique(np.concatenate((rng.integers(0, 4, 2) if toxic else rng.integers(4, 8, 2), rng.integers(8, 400, 3)))).astype(np.int32)
    pos, truth = [text(True) for _ in range(60)], rng.random(600) < 0.4
    mix = [text(t) for t in truth]
    w, bias = toxicity.nnpu(pos, mix, 400, 0.4)
    zp, zu = toxicity._sums(pos, w) + bias, toxicity._sums(mix, w) + bias
    assert toxicity.pu_risk(zp, zu, 0.4)[1] > -0.05
    called = zu >= toxicity.pu_cut(*toxicity.crossed(pos, mix, 400, 0.4), 0.4)
    print("planted", (called & truth).sum() / truth.sum(), (called & truth).sum() / called.sum())
    assert (called & truth).sum() / truth.sum() > 0.9 and (called & truth).sum() / called.sum() > 0.9
    plain, b = toxicity.nnpu(pos, mix, 400, 1e-6)  # without a prior, the mixture counts as not toxic
    assert ((toxicity._sums(mix, plain) + b > 0) & truth).sum() / truth.sum() < 0.2


def test_toxicity_features_are_words_and_their_beginnings():
    """Two texts share as many features as they share words and beginnings of words, by plain Python."""
    import re

    def plain(text):
        low = "".join(c.lower() if c < "\x80" or "À" <= c <= "Þ" and c != "×" else c for c in text)
        words = [w.encode() for w in re.findall("(?:[a-z]|[^\x00-\x7f])+", low)]
        return {(0, w) for w in words} | {(n, w[:n]) for w in words for n in (4, 5, 6) if len(w) > n}

    texts = ["", "Alpha beta's ALPHABETICAL", "alphabet été ÉTÉ-ÊTRE", "×÷ x9y 漢字かな", "alphabetic alpha ALPH", "a " * 50 + "été"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    row, feature = toxicity.features(data, offsets)
    got = [set(feature[row == i].tolist()) for i in range(len(texts))]
    want = [plain(t) for t in texts]
    for i in range(len(texts)):
        assert len(got[i]) == len(want[i]), texts[i]
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(want[i] & want[j]), (texts[i], texts[j])


def test_cut_by_hand():
    assert toxicity.pu_cut(np.array([2.0, 3.0]), np.array([0.0, 1.0, 2.0, 3.0]), 0.5) == 1.5
    assert toxicity.pu_cut(np.array([1.0]), np.array([1.0]), 0.5) == 1.0


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} good text {'BADWORD' if i % 4 == 0 else 'fine'} here", 0.5) for i in range(400)] + [(900, None, 1.0), (901, "", 1.0), (None, "badword " * 9000, None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400, 2)] + [(None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id is not null"), labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[None] > 0.3 > got[900] and got[900] == got[901] and got[8] > 0.3 > got[9]
    nothing = toxicity.fit(docs, labels.where("false"))
    assert max(r.score for r in toxicity.score(docs, nothing).collect()) < 0.01
    assert toxicity.score(docs.where("false"), model).count() == 0


def planted_licenses():
    """(how, license, text) of every known whole licence as it may stand in a file."""
    import textwrap

    known = {}
    for name, text in licenses.whole_texts():
        known.setdefault(licenses.plain_canonical(text), (name, text))
    wrap = lambda text, n: "\n\n".join(textwrap.fill(" ".join(p.split()), n) for p in re.split(r"\n\s*\n", text))
    for name, text in known.values():
        yield "as it is", name, text
        yield "in capitals", name, text.upper()
        yield "other spelling", name, text.replace("license", "licence").replace("favor", "favour")
        yield "under a holder", name, f"Copyright (c) 2021-2024 Some One <one@example.com>\n\n{text}"
        yield "inside a document", name, f"Words before it.\n\n{text}\n\nWords after it."
        for n in (64, 72, 79):
            yield f"wrapped at {n}", name, wrap(text, n)


def test_license_recall(spark):
    """Of planted whole licences nine in ten and more are found, however they stand."""
    planted = list(planted_licenses())
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(planted)], "doc_id long, text string").repartition(8)
    found = {(r.doc_id, r.license) for r in licenses.scan(df).collect()}
    hits = collections.defaultdict(list)
    for i, (how, name, _) in enumerate(planted):
        hits[how].append((i, name) in found)
    recall = {how: sum(h) / len(h) for how, h in hits.items()}
    assert sum(map(sum, hits.values())) / len(planted) >= 0.9, recall
    assert all(r == 1 for how, r in recall.items() if not how.startswith("wrapped")), recall
