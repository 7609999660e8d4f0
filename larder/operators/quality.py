"""Composite quality score of a product (higher is better, about 0 to 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import tables
from larder.functions.text import literal_map


def nutrient_quality() -> Column:
    """Mean of up to six 0-5 points over the amounts that are present; 2.5 without any."""
    points, present = F.lit(0.0), F.lit(0)
    for name, fine, worst in tables.PENALISED_LEVELS:
        amount = F.col(name)
        ramp = F.lit(5.0) * (F.lit(worst) - amount) / F.lit(worst - fine)
        earned = F.when(amount <= fine, F.lit(5.0)).when(amount >= worst, F.lit(0.0)).otherwise(ramp)
        points += F.when(amount.isNotNull(), earned).otherwise(F.lit(0.0))
        present += amount.isNotNull().cast("int")
    for name, enough in tables.REWARDED_LEVELS:
        amount = F.col(name)
        earned = F.least(F.lit(5.0), amount / F.lit(enough) * F.lit(5.0))
        points += F.when(amount.isNotNull(), earned).otherwise(F.lit(0.0))
        present += amount.isNotNull().cast("int")
    return F.when(present > 0, points / present).otherwise(F.lit(2.5))


def composite_quality(nutrient_points: Column) -> Column:
    """Grade 40 %, processing 25 %, additives 15 %, nutrients 20 %."""
    grade = F.coalesce(F.try_element_at(literal_map(tables.GRADE_QUALITY), F.col("nutriscore")), F.lit(2.5))
    nova = F.col("nova_group")
    processing = F.when(
        nova.between(1, 4), ((F.lit(5.0) - nova) / F.lit(4.0)) * F.lit(5.0) * F.lit(0.25)
    ).otherwise(F.lit(1.25))
    additives = F.greatest(F.lit(0.0), (F.lit(10.0) - F.col("additives_count")) / F.lit(10.0)) * F.lit(5.0)
    return grade * F.lit(0.40) + processing + additives * F.lit(0.15) + nutrient_points * F.lit(0.20)


def add_quality(products: DataFrame) -> DataFrame:
    """Add ``nutrient_quality`` and ``quality``."""
    staged = products.withColumn("nutrient_quality", nutrient_quality())
    return staged.withColumn("quality", composite_quality(F.col("nutrient_quality")))
