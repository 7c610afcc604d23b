"""Classification of section titles into retrieval lanes.

Cheapest test first; each later stage only sees the rows the earlier ones left open.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions import similarity as sim, vectors as vx
from dossierlake.session import materialise

# Thresholds and lane names.
BOILERPLATE_RATIO = 0.6
AMBIGUITY_MARGIN = 0.05
MEMOIRE, PROGRAMME, BOILERPLATE = "memoire", "programme", "boilerplate"

# Titles labelled as reusable from one project to the next.
GENERIC_TITLES = (
    "Méthode de diagnostic",
    "Organisation et présentation de l'équipe",
    "Une organisation structurée",
    "Le management de la validation",
    "Méthodologie",
    "Approche développement durable",
    "Lutte contre les ilots de chaleur et confort d'été",
    "Utilisation de matériaux de réemploi et de matériaux biosourcés",
    "Organisation du groupement",
    "Répartition des tâches entre les membres de l'équipe",
    "Présentation du groupement",
    "Moyens humains",
    "Moyens matériels",
    "Présentation de l'équipe",
    "Références en milieu occupé",
    "Méthodologie de travail mise en place",
    "Qualité documentaire de la réalisation (DOE)",
    "RSE et développement durable",
    "Démarche d'économie circulaire",
    "Gestion et protection des données",
)

# Titles labelled as specific to one project.
SPECIFIC_TITLES = (
    "Compréhension du projet",
    "Site",
    "Le bâti",
    "Calendrier prévisionnel",
    "Présentation du site et organisation du bâtiment",
    "Diagnostic visuel de l'existant et pistes d'intervention",
    "Cohérence avec le programme et le budget",
    "Justification des choix techniques en regard du budget alloué",
    "Enjeux de la mission",
    "Analyse du site",
    "Analyse du programme",
    "Analyse structure",
    "Estimatif travaux",
    "Caractéristiques des bâtiments",
    "Compréhension de l'opération",
    "Les enjeux techniques",
    "Planning détaillé",
    "Analyse financière détaillée du budget de la maitrise d'ouvrage",
    "Critique du programme",
    "Prise en compte des locataires",
)


def centroids(vectors: DataFrame, label: str, embedding: str = "embedding") -> DataFrame:
    """Component-wise mean vector per label: one map-side combined pass, no exploding."""
    as_vector = array_to_vector(F.col(embedding).cast("array<double>"))
    return vectors.groupBy(label).agg(vector_to_array(Summarizer.mean(as_vector)).alias("centroid"))


def lane_centroids(labelled: DataFrame, lane: str = "lane") -> dict[str, list[float]]:
    """The two lane centroids as plain numbers: two rows, whatever the size of the input."""
    both = centroids(labelled.filter(F.col(lane).isin(MEMOIRE, PROGRAMME)), lane)
    return {row[lane]: list(row["centroid"]) for row in both.collect()}


def exemplar_centroids(model=vx.hashed_vectors) -> dict[str, list[float]]:
    """Lane centroids of the labelled exemplar titles, with the model used for the titles."""
    groups = {MEMOIRE: GENERIC_TITLES, PROGRAMME: SPECIFIC_TITLES}
    return {lane: [float(x) for x in pd.DataFrame(model(list(titles))).mean()] for lane, titles in groups.items()}


def _literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def nearest_lane(titles: DataFrame, lanes: dict[str, list[float]], embedding: str = "embedding") -> DataFrame:
    """Adds lane, method and confidence; lane is null where the two cosines are too close."""
    sims = titles.select("*", F.round(vx.cosine(F.col(embedding), _literal(lanes[MEMOIRE])), 9).alias("_m"),
                         F.round(vx.cosine(F.col(embedding), _literal(lanes[PROGRAMME])), 9).alias("_p"))
    gap = F.abs(F.col("_m") - F.col("_p"))
    clear = gap >= AMBIGUITY_MARGIN
    lane = F.when(clear, F.when(F.col("_m") > F.col("_p"), MEMOIRE).otherwise(PROGRAMME))
    return sims.withColumn("lane", lane).withColumn("method", F.when(clear, "embedding")).withColumn(
        "confidence", F.when(clear, F.round(gap, 3))).drop("_m", "_p")


def is_boilerplate(title: Column, names: list[str]) -> Column:
    """Whether a title is similar enough to a boilerplate name."""
    return sim.best_ratio(title, names) >= BOILERPLATE_RATIO


def answered_lane(answer: Column) -> Column:
    return F.when(F.contains(F.lower(answer), F.lit(PROGRAMME)), PROGRAMME).otherwise(MEMOIRE)


def cascade(titles: DataFrame, boilerplate: list[str], lanes: dict[str, list[float]], model=vx.hashed_vectors,
            ask: Callable[[list[str]], list[str]] | None = None, title: str = "title") -> DataFrame:
    """Adds lane, method and confidence: dictionary, then centroids, then `ask` for what is left.

    Each distinct title is judged once, and titles settled by an early stage never reach a later one. Without `ask`
    ambiguous titles count as reusable. A null title is similar to nothing and counts as an empty ambiguous one.
    """
    distinct = titles.select(F.coalesce(title, F.lit("")).alias("_title")).distinct()
    # Written between the stages, so no model or similarity runs again in another branch.
    marked = materialise(distinct.withColumn("_b", F.coalesce(is_boilerplate(F.col("_title"), boilerplate), F.lit(False))))
    fixed = marked.filter("_b").select("_title", F.lit(BOILERPLATE).alias("lane"), F.lit("dict").alias("method"), F.lit(None).cast("double").alias("confidence"))
    embedded = materialise(marked.filter("NOT _b").select("_title", vx.embed(F.col("_title"), model).alias("_e")))
    near = nearest_lane(embedded, lanes, "_e").drop("_e")
    clear, unclear = near.filter(F.col("lane").isNotNull()), near.filter(F.col("lane").isNull())
    if ask is None:
        answer = F.lit("")
    else:
        @F.pandas_udf("string")
        def asked(parts: pd.Series) -> pd.Series:
            return pd.Series(ask(parts.tolist()))

        answer = asked(F.col("_title"))
    settled = unclear.withColumn("lane", answered_lane(answer)).withColumn("method", F.lit("llm_fallback"))
    judged = fixed.unionByName(clear).unionByName(settled)
    return titles.withColumn("_title", F.coalesce(title, F.lit(""))).join(judged, "_title").drop("_title")


def label_counts(rows: DataFrame, actual: str = "label", predicted: str = "lane") -> DataFrame:
    """Confusion table of labels and predicted lanes."""
    return rows.groupBy(actual, predicted).agg(F.count("*").alias("n"))
