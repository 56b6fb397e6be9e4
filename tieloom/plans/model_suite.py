"""The count models of the analysis: design rows and term lists."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tieloom.operators.count_models import Model, with_products
from tieloom.operators.features import cross_affiliation, multi_hot, one_hot, women

# The predictors under study, and the names of the nested models.
KEY_PREDICTORS = ["degree", "normalized_brokerage", "constraint", "normalized_homophily"]
CONTROLS = ["baseline_output", "avg_year_diff", "years_from_first_pub", "interdisciplinary_reach"]
NESTED_NAMES = [f"Model {n}" for n in range(1, 12)] + ["Model 11a", "Model 11b"]


def dummies(values: list[str], prefix: str, reference: str) -> list[str]:
    return [f"{prefix}_{v}" for v in values if v != reference]


def multihot_design(
    table: DataFrame, countries: list[str], subjects: list[str], ref_country: str, ref_subject: str
) -> DataFrame:
    """One row per unit; a unit has a 1 for each of its countries and subjects."""
    df = table.withColumn("women", women())
    df = multi_hot(df, "countries_focal", countries, "country", ref_country)
    return multi_hot(df, "subjects_focal", subjects, "subject", ref_subject)


def exploded_design(
    table: DataFrame, countries: list[str], subjects: list[str], ref_country: str, ref_subject: str
) -> DataFrame:
    """One row per unit, country and subject; a unit with k pairs counts k times in a fit."""
    df = cross_affiliation(table.withColumn("women", women()), "countries_focal", "subjects_focal")
    df = one_hot(df, "country", countries, "country", ref_country)
    return one_hot(df, "subject", subjects, "subject", ref_subject)


def nested_models(outcome: str, places: list[str]) -> list[Model]:
    """13 models: controls; plus each key predictor; plus all; each and all with products.

    11a and 11b are the last model without constraint and without normalized brokerage.
    ``places`` are the country and subject dummies.
    """
    controls = places + CONTROLS
    without = {
        "Model 11a": [k for k in KEY_PREDICTORS if k != "constraint"],
        "Model 11b": [k for k in KEY_PREDICTORS if k != "normalized_brokerage"],
    }
    single = [[k] for k in KEY_PREDICTORS]
    plain = [[], *single, KEY_PREDICTORS]
    crossed = [*single, KEY_PREDICTORS, *without.values()]
    lists = [(keys, []) for keys in plain] + [(keys, keys) for keys in crossed]
    return [
        Model(name, outcome, with_products(["women", *keys, *controls], "women", products))
        for name, (keys, products) in zip(NESTED_NAMES, lists)
    ]


def main_model(outcome: str, places: list[str]) -> Model:
    """All key predictors, controls, and products of women with the key predictors."""
    return Model(
        "main", outcome, with_products(["women", *KEY_PREDICTORS, *places, *CONTROLS], "women", KEY_PREDICTORS)
    )


def constraint_model(outcome: str, places: list[str], crossed: str = "none") -> Model:
    """Constraint, homophily and degree without brokerage.

    ``crossed`` is ``"none"``, ``"key"`` (women with these three) or ``"all"`` (also with
    the country and subject dummies).
    """
    keys = ["constraint", "homophily", "degree"]
    controls = [c for c in CONTROLS if c != "avg_year_diff"]
    products = {"none": [], "key": keys, "all": [*keys, *places]}[crossed]
    return Model(
        f"constraint, products {crossed}",
        outcome,
        with_products(["women", *keys, *places, *controls], "women", products),
    )
