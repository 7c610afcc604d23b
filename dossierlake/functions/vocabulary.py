"""Section dictionaries, vocabularies and queries in the documents' language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from dossierlake.functions import text as tx

# Sections looked for in consultation documents.
CONSULTATION_SECTIONS = {
    "structure_memoire": {
        "label": "Structure du mémoire technique",
        "variants": [
            "structure du mémoire technique",
            "structure de mémoire",
            "structure du mémoire",
            "structure attendue du mémoire technique",
            "sommaire attendu du mémoire technique",
            "plan attendu du mémoire",
            "plan du mémoire technique",
            "contenu attendu du mémoire technique",
            "composition du mémoire technique",
            "contenu du mémoire technique",
        ],
    },
    "criteres_jugement": {
        "label": "Critères de jugement des offres",
        "variants": [
            "critères de jugement des offres",
            "critère de jugement",
            "critères de jugement",
            "jugement des offres",
            "critères d'attribution",
            "critères de notation",
            "pondération des critères",
            "modalités de jugement des offres",
            "critères d'évaluation des offres",
        ],
    },
    "criteres_selection": {
        "label": "Critères de sélection des candidatures",
        "variants": [
            "critères de sélection",
            "critère de sélection",
            "critères de sélection des candidatures",
            "conditions de recevabilité des candidatures",
            "conditions de participation",
            "capacités techniques et professionnelles",
        ],
    },
}

# Sections that need no retrieval.
BOILERPLATE_SECTIONS = {
    "mentions_legales": {
        "label": "Mentions légales / signature",
        "variants": ["mentions légales", "signature", "fait à", "cachet de l'entreprise"],
    },
}

# Contents headings, never sections themselves.
CONTENTS_TITLES = (
    "sommaire",
    "table des matieres",
    "table des matières",
    "index",
    "plan du document",
    "sommaire detaille",
    "sommaire détaillé",
)

# Titles of the materials section, accents folded.
MATERIALS_TITLES = (
    "liste des materiaux ou produits",
    "liste des materiaux et produits",
    "liste des produits et materiaux",
    "liste des produits ou materiaux",
    "conclusion detaille du reperage",
    "conclusion detaillee du reperage",
    "conclusions du rapport",
    "conclusion du reperage",
    "liste des materiaux",
    "resultats du reperage",
    "bilan du reperage",
    "reperage des materiaux",
    "materiaux reperes",
    "conclusion detaille",
    "resultats",
    "recapitulatif zone par zone",
)
FALLBACK_NUMBERS = ("5", "4", "3", "2")

# Search text per category when no heading matches.
FALLBACK_QUERIES = {
    "structure_memoire": (
        "Structure, plan, sommaire et contenu attendu du mémoire technique que le candidat doit produire, "
        "avec le détail des chapitres et parties à rédiger."
    ),
    "criteres_jugement": (
        "Critères de jugement, d'évaluation et de notation des offres, pondération et modalités d'attribution du marché."
    ),
    "criteres_selection": (
        "Critères de sélection des candidatures, conditions de recevabilité et capacités techniques et professionnelles "
        "exigées des candidats."
    ),
}
DEFAULT_CATEGORY = "structure_memoire"


def names(entry: dict) -> list[str]:
    return [entry["label"], *entry.get("variants", [])]


def _strings(values, form: Callable[[Column], Column] = lambda c: c) -> Column:
    """Fixed texts in some form. The form is written out for each, so that Spark works it out once and not in each row."""
    return F.array(*[form(F.lit(v)) for v in values])


def _holds(entry: dict, key: Column) -> Column:
    """Whether any name of the entry equals or contains the normalised hint."""
    return F.exists(_strings(names(entry), tx.title_key), lambda n: F.contains(n, key))


def category_of(hint: Column, dictionary: dict, default: str = DEFAULT_CATEGORY) -> Column:
    """The first category with a name equal to or containing the hint, else the default."""
    key = tx.title_key(hint)
    given = F.coalesce(hint != "", F.lit(False))
    return F.coalesce(*[F.when(given & _holds(e, key), c) for c, e in dictionary.items()], F.lit(default))


def candidate_pool(hint: Column, dictionary: dict, default: str | None = None, form: Callable[[Column], Column] = lambda c: c) -> Column:
    """Names a heading is compared with, each in some form: the hinted entry's, the hint itself, the default entry's, or all."""
    key = tx.title_key(hint)
    if default in dictionary:
        no_hint = _strings(names(dictionary[default]), form)
    else:
        no_hint = _strings([n for e in dictionary.values() for n in names(e)], form)
    hinted = [F.when(_holds(e, key), _strings(names(e), form)) for e in dictionary.values()]
    return F.when(F.coalesce(hint == "", F.lit(True)), no_hint).otherwise(F.coalesce(*hinted, F.array(form(hint))))
