"""Section matching: cases in invented wording for each rule of where a section starts and ends."""

import difflib

import pytest
from pyspark.sql import functions as F

from dossierlake.functions import similarity as sim, vocabulary as vo
from dossierlake.operators import sections as sc

SOMMAIRE = "# SOMMAIRE\n1. Objet\n\n## ARTICLE 4 JUGEMENT DES OFFRES\nLa note est sur cent.\n"
PARENT = ("# TITRE I - SELECTION ET JUGEMENT DES OFFRES PAR LA COMMISSION\navant.\n\n## ARTICLE 4 CRITERES DE JUGEMENT DES OFFRES\n"
          "dedans.\n\n## ARTICLE 5 DELAIS\ndehors.\n")
LISTED = "## ARTICLE 4 CRITERES DE JUGEMENT DES OFFRES\ndebut.\n## 1) Technique\npremier.\n## 2) Prix\nsecond.\n## ARTICLE 5 DELAIS\ndehors.\n"
CHAPTERS = "## 3. Structure du mémoire technique\nil faut :\n### 3.1 Equipe\nqui.\n### 3.2 Moyens\nquoi.\n## 4. Autre\ndehors.\n"
NESTED = "## 6.1 - Visite\navant.\n## 6.2 - Jugement des offres\nintro.\n## 6.2.1 – Note\nprincipal.\n## 6.2.2 – Detail\nfin.\n## 7. Suite\ndehors.\n"
REFERRED = "## 6.2.1 - Jugement des offres\nvoir (6.2.2) ci-dessous.\n## 6.2.2 - Baremes\ncontenu cité.\n## 6.3 - Suite\ndehors.\n"
UNREFERRED = "## 6.2.1 - Jugement des offres\nrien à voir.\n## 6.2.2 - Baremes\nnon lié.\n## 6.3 - Suite\ndehors.\n"
RESTART = ("## 6.2.1 - Jugement des offres\nvoir (6.2.2).\n## 6.2.2 - Baremes\nbareme.\n## 1. Prix\nun.\n## 2. Equipe\ndeux.\n## 7. Suite\ndehors.\n")
TWO = "## ARTICLE 3 CRITERES DE SELECTION DES CANDIDATURES\na.\n## ARTICLE 4 CRITERES DE JUGEMENT DES OFFRES\nb.\n"
FREE = "## Pièces à joindre au pli\ncontenu.\n"
NONE = "## Tout autre chose entièrement\nrien.\n"
CRITERIA = "## ARTICLE 4 JUGEMENT DES OFFRES\na.\n## Critère 1 : prix\nb.\n## Sous-critère 2\nc.\n## ARTICLE 5 DELAIS\nd.\n"

CASES = [
    # text, hint, heading prefix, contained, not contained
    (SOMMAIRE, None, "ARTICLE 4", ["La note"], []),
    (PARENT, None, "ARTICLE 4", ["dedans."], ["dehors."]),
    (LISTED, None, "ARTICLE 4", ["premier.", "second."], ["dehors."]),
    (CHAPTERS, "structure du mémoire", "3.", ["qui.", "quoi."], ["dehors."]),
    (NESTED, "critère de jugement", "6.2 ", ["principal.", "fin."], ["dehors.", "avant."]),
    (REFERRED, "critère de jugement", "6.2.1", ["contenu cité.", sc.CROSS_REFERENCE], ["dehors."]),
    (UNREFERRED, "critère de jugement", "6.2.1", [], ["non lié."]),
    (RESTART, "critère de jugement", "6.2.1", ["bareme.", "un.", "deux."], ["dehors."]),
    (TWO, None, "ARTICLE", [], []),
    (FREE, "Pièces à joindre au pli", "Pièces", ["contenu."], []),
    (NONE, "critères de jugement des offres", None, [], []),
    (CRITERIA, None, "ARTICLE 4", ["b.", "c."], ["d."]),
]


@pytest.fixture(scope="module")
def matched(spark):
    docs = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "doc_id long, text string, hint string")
    return {r.doc_id: r for r in sc.match_sections(docs, vo.CONSULTATION_SECTIONS, hint="hint").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_match(matched, i):
    _, _, heading, inside, outside = CASES[i]
    if heading is None:
        assert i not in matched
        return
    row = matched[i]
    assert row.heading.startswith(heading) and row.score >= sc.MATCH_THRESHOLD
    assert all(x in row.text for x in inside)
    assert not any(x in row.text for x in outside)


@pytest.mark.parametrize("title,number", [
    ("ARTICLE 12 DELAIS", [12]), ("6.2 - NOTES", [6, 2]), ("6.2.1 – Notes", [6, 2, 1]), ("1) Technique", [1]), ("PREAMBULE", None),
])
def test_numeric_prefix(spark, title, number):
    assert spark.range(1).select(sc.numeric_prefix(F.lit(title)).alias("n")).first().n == number


def _plain_score(title, pool):
    best = 0.0
    if title in vo.CONTENTS_TITLES:
        return best
    for c in pool:
        r = difflib.SequenceMatcher(None, title, c).ratio()
        if c in title or title in c:
            a, b = sorted((len(title), len(c)))
            r = max(r, 0.5 + 0.45 * a / b if b else r)
        best = max(best, r)
    return best


def test_scores_equal_a_plain_fold(spark):
    titles = ["tide", "critères de jugement", "sommaire", "plan du mémoire", "x" * 250 + " y", "jugement", ""]
    pool = ["diet", "critères de jugement des offres", "plan du mémoire technique", "x" * 230]
    df = spark.createDataFrame([(titles, pool)], "t array<string>, p array<string>")
    got = df.select(sim.heading_scores(F.col("t"), F.col("p")).alias("s")).first().s
    assert got == pytest.approx([_plain_score(t, pool) for t in titles], abs=1e-12)


def test_long_outlines_are_bounded_like_a_plain_scan(spark):
    """More headings than the first look-ahead windows hold."""
    levels = [1] + [3] * 700 + [2] + [3] * 30 + [1, 2]
    text = "\n".join(f"{'#' * v} titre {'abc'[i % 3]}\ncorps {i}" for i, v in enumerate(levels))
    rows = sc.all_sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    for r in rows:
        later = [j for j in range(r.heading_no + 1, len(levels)) if levels[j] <= levels[r.heading_no]]
        assert r.end_line == (2 * later[0] if later else 2 * len(levels))


def plain_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp by its definition: the longest common stretch (leftmost in `a`, then in `b`), then both sides."""

    def matched(a0, a1, b0, b1):
        best = (0, 0, 0)
        for i in range(a0, a1):
            for j in range(b0, b1):
                k = 0
                while i + k < a1 and j + k < b1 and a[i + k] == b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        return k + matched(a0, i, b0, j) + matched(i + k, a1, j + k, b1) if k else 0

    return 2 * matched(0, len(a), 0, len(b)) / (len(a) + len(b)) if a or b else 1.0


def test_scores_of_all_titles_against_a_plain_fold(spark, sf):
    """Every distinct title of the fixture, for the queries whose similarity has no SQL."""
    from dossierlake.functions import similarity as sim, text as tx, vocabulary as vo
    from dossierlake.operators import classify as cl
    from workload.dialogue_queries import BOILERPLATE
    from workload.section_queries import headed
    rows = sc.headings(headed(spark, sf)).select("title", "title_key").distinct().collect()
    titles = sorted({r.title_key[:60] for r in rows})[::5]
    names = [n for e in vo.CONSULTATION_SECTIONS.values() for n in vo.names(e)]
    pool = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(tx.title_key(F.col("n"))).collect()]
    got = spark.createDataFrame([(titles, pool)], "t array<string>, p array<string>").select(sim.heading_scores(F.col("t"), F.col("p")).alias("s")).first().s
    for title, score in zip(titles, got):
        want = 0.0
        if title not in vo.CONTENTS_TITLES:
            for name in pool:
                short, long = sorted((len(title), len(name)))
                inside = 0.5 + 0.45 * short / long if long and (name in title or title in name) else 0.0
                want = max(want, inside, plain_ratio(title, name))
        assert abs(score - want) < 1e-12, title
    keys = [r[0] for r in spark.createDataFrame([(n,) for n in BOILERPLATE], "n string").select(tx.title_key(F.col("n"))).collect()]
    some = [r for r in rows if len(r.title_key) <= 40][::7] + [None]
    asked = spark.createDataFrame([(r.title if r else None,) for r in some], "title string")
    flags = [r[0] for r in asked.coalesce(1).select(cl.is_boilerplate(F.col("title"), BOILERPLATE)).collect()]
    assert flags == [bool(r) and max(plain_ratio(r.title_key, k) for k in keys) >= cl.BOILERPLATE_RATIO for r in some]


def test_the_best_heading_is_found_in_one_pass(spark):
    """The filter on the score does not compare the headings again, and the first of the best wins."""
    titles = [["Sommaire"], ["Critères de jugement", "Mentions légales", "critères de jugement"], ["zz"], [], ["Mentions", "Critères de jugements", "CRITERES de jugement des offres"], ["Plan du mémoire " + "x" * 240]]
    docs = spark.createDataFrame([(i, "\n".join(f"# {t}\ncorps" for t in own), [None, "", "critère", "autre"][i % 4]) for i, own in enumerate(titles)], "doc_id long, text string, hint string")
    for threshold in (0.0, 0.3, 0.55, 0.9):
        scores = {}
        for r in sc.heading_score_rows(docs, vo.CONSULTATION_SECTIONS, hint="hint").collect():
            scores.setdefault(r.doc_id, {})[r.heading_no] = r.score
        want = {d: (min(h for h in own if own[h] == max(own.values())), round(max(own.values()), 3)) for d, own in scores.items() if max(own.values()) >= threshold}
        best = sc.best_headings(docs, vo.CONSULTATION_SECTIONS, threshold, hint="hint")
        assert {r.doc_id: (r.heading_no, r.score) for r in best.collect()} == want and len(want) >= 1
        assert best._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ArrowEvalPython") == 1


def test_full_comparisons_are_made_where_they_can_decide():
    """A title that equals one candidate is compared with that one only."""
    import pandas as pd

    names = [f"critere {c * 9}" for c in "abcdefghij"]
    pool = sim._pooled(pd.Series([names[3:4]]), pd.Series([names]), True, frozenset())[0]
    asked = []
    for m in pool.matchers:
        m.ratio = lambda m=m, ratio=m.ratio: asked.append(m.b) or ratio()
    assert pool.score(names[3]) == 1.0 and asked == [names[3]]
