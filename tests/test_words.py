"""Queries in words: parsed as columns, misspelt, and saved; each against plain Python."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import vocab
from tessera.operators import close
from tessera.plans import saved, search

from .test_stored import frames, mat


def texts(seed, n):
    r = random.Random(seed)
    parts = [*vocab.COLORS, *(w for w, _ in vocab.QUERY_TYPES), *vocab.FORMS, *vocab.QUERY_FINISHES, *vocab.SPELLINGS, *vocab.STOP[:8], "20mm", "3 cm", "1.2cm", "12.5 mm", "30cmx", "calacatta", "taj", "x", "x1", "A", "blueish", "greystone", "slabby", "été", "$1\\E", "\t", "WHITE"]
    return [r.choice(("", " ", ", ", "-")).join(r.choice((str, str.upper, str.title))(r.choice(parts)) + r.choice((" ", "s ", ", ", "")) for _ in range(r.randrange(0, 7))) for _ in range(n)] + ["", " ", "Show me honed calcutta marble 20mm light blue tiles"]


def test_parse_as_a_column(spark):
    rows = [(t,) for t in texts(7, 400)] + [(None,)]
    got = spark.createDataFrame(rows, "t string").select("t", search.asked(F.col("t")).alias("a")).collect()
    for r in got:
        want = search.parse(r.t or "")
        assert (r.a.material_type, r.a.color, r.a.thickness, r.a.form, list(r.a.terms)) == (want.material_type, want.color, want.thickness, want.form, want.terms), r.t


@pytest.mark.parametrize("cutoff", [0.801, 0.82, 0.9, 1.0])
def test_close_pairs_equal_all_pairs(spark, cutoff):
    r = random.Random(3)
    words = {"".join(r.choice("ABCANTE") for _ in range(r.randrange(1, 14))) for _ in range(150)} | {"CALACATTA", "AAAAAAAA", "AAAAAAAAA", "A", "AB", "ABC", "É", "BIANCO"}

    def misspelt(w):
        i = r.randrange(len(w)) if w else 0
        return r.choice((w[:i] + w[i + 1 :], w[:i] + "X" + w[i:], w[:i] + w[i:][::-1], w + w[-1:], w))

    terms = {misspelt(misspelt(w)) for w in words for _ in range(2)} | {"", "CALACATA"}
    got = {(x.term, x.w): x.ratio for x in close.close_pairs(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(w,) for w in words], "w string"), cutoff).collect()}
    want = {(t, w): q for t in terms if t for w in words if (q := difflib.SequenceMatcher(None, w, t).ratio()) >= cutoff}
    assert got == want and len(want) > 20
    best = close.closest(spark.createDataFrame([(t, w, q) for (t, w), q in want.items()], "term string, w string, ratio double")).collect()
    for t in ("CALACATA", *list(terms)[:20]):
        if t:
            assert [x.w for x in sorted(best, key=lambda x: x.rank) if x.term == t] == difflib.get_close_matches(t, words, 4, cutoff)


def test_low_cutoffs_are_refused(spark):
    with pytest.raises(ValueError):
        close.close_pairs(spark.createDataFrame([("A",)], "term string"), spark.createDataFrame([("A",)], "w string"), 0.8)


def catalog():
    r = random.Random(11)
    first, second = ("calacatta", "taj", "blue", "absolute", "grey", "white", "rosso"), ("gold", "mahal", "bahia", "black", "viola", "tile", "oro")
    kinds = ("Marble", "Granite", "Quartz", vocab.ACCESSORY)
    rows = []
    for _ in range(160):
        name, kind = f"{r.choice(first)} {r.choice(second)}", r.choice(kinds)
        row = list(mat(r.randrange(1, 7), r.choice((f"{name}|{kind.lower()}", "")), slabs=r.randrange(9), form=r.choice(("SLAB", "TILE", "")), mtype=kind, name=name.title(), thickness=r.choice(("2cm", "3cm", "")), new=r.randrange(2)))
        row[14] = r.choice(("", "Light Blue", "Gray, White", "Grey", "Red"))
        rows.append(tuple(row))
    return rows


SAVED = ["calacatta", "calac gold", "CALACATTA marble 3cm", "blue", "grey slabs", "white tile", "light blue granite", "taj mahal quartz", "absolut blck", "3cm", "marble", "tiles", "", "zz", "go", "a", "rosso vioal", "nothing like it", "sinks", "polished taj", "viola 2cm white", "calacata oro", "blue marble", "absolute absolute", "mahal", "hal mah"]


def test_saved_searches_equal_a_loop_of_searches(spark):
    m, s = frames(spark, catalog())
    m = m.cache()
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(SAVED)] + [(100, "calacatta")], "search_id int, query string")
    got = {r.search_id: (r.total, r.new, r.fuzzy) for r in saved.totals(m, s, queries).collect()}
    assert got[100] == got[0]
    for i, q in enumerate(SAVED):
        found = search.search(m, s, q)
        new = search.search(m, s, q, search.Filters(new_only=True)) if not found.fuzzy else None
        assert got[i][0] == found.total and got[i][2] == bool(found.fuzzy), q
        # that of new ones has its own retry, which the saved total doesn't follow
        assert new is None or new.fuzzy or got[i][1] == new.total, q


def test_a_thousand_saved_searches(spark):
    rows = catalog()
    m, s = frames(spark, rows)
    r = random.Random(2)
    words = ["calac", "gold", "blue", "marble", "granite", "quartz", "3cm", "2cm", "slab", "tile", "white", "gray", "taj", "mah", "red", "vi", "oro", "bahia", "black"]
    queries = [" ".join(r.sample(words, r.randrange(1, 4))) for _ in range(1000)]
    frame = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "search_id int, query string")
    asked = frame.select("query").distinct().select("query", search.asked(F.col("query")).alias("asked")).withColumn("variants", F.transform("asked.terms", lambda t: F.array(t)))
    got = {(x.query, x.grp): x.new for x in saved.matches(saved.kinds(m, s), asked).collect()}
    want = {}
    for q in set(queries):
        a = search.parse(q)
        base = search.color_word(a.color) if a.color else ""
        for x in rows:
            name, kind, form, color = x[3].lower(), x[6], x[7], x[14]
            words_of = color.lower().replace("grey", "gray").replace("/", " ").replace(",", " ").split()
            if (
                all(t in name for t in a.terms) and a.material_type.lower() in ("", kind.lower()) and kind != vocab.ACCESSORY and a.thickness in ("", x[15])
                and (not a.color or base in words_of or base in name.replace("grey", "gray")) and (not a.form or a.form.upper() in form.upper() or (a.form != "slab" and a.form.upper() in name.upper()))
            ):
                grp = x[5] or f"id:{x[0]}"
                want[q, grp] = want.get((q, grp), False) or x[13] == 1
    assert got == want and len(want) > 200
