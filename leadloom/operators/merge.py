"""Cross-source merge: listings of one company -> one record.

Rules (row order given by ``ord``):
  * rows with an empty name, or whose name key is empty, are dropped;
  * name: the first row's raw name;
  * phone: the first mobile phone, else the first non-empty phone, else '';
  * website: the first value starting with 'http' (case-sensitive), else the
    first row's value, even if empty;
  * address, category, company_size, rating and the three URLs: first
    non-empty value;
  * sources: the first row's source, then each later source that is not
    already a substring of the text so far, joined with ', ';
  * phone_type is recomputed from the chosen phone; the sink orders mobile,
    landline, none, then by the company's first ``ord``.

Plan: two hash aggregations with map-side partial aggregation. The first
groups by (key, source) and reduces every rule to a (value, ord) candidate; the
second groups by key and picks the candidate with the lowest ord. Nothing
collects rows per company: the only list kept is one entry per distinct
source, so a company holding a third of all rows costs no more memory than
any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify_phone, name_key
from ..schemas import conform_listings

FIRST_NON_EMPTY = ["address", "category", "company_size", "rating",
                   "google_maps_url", "jobstreet_url", "hiredly_url"]

MERGED_COLUMNS = ["name_key", "name", "phone", "phone_type", "website", "address", "category",
                  "company_size", "rating", "sources", "google_maps_url", "jobstreet_url",
                  "hiredly_url", "first_ord", "type_rank"]


def _rules() -> dict[str, tuple[str, Column | None]]:
    """rule name -> (value column, condition or None for 'first row')."""
    pt = classify_phone("phone")
    rules: dict[str, tuple[str, Column | None]] = {
        "name": ("name", None),
        "phone_mobile": ("phone", pt == "mobile"),
        "phone_any": ("phone", F.col("phone") != ""),
        "website_http": ("website", F.col("website").startswith("http")),
        "website_first": ("website", None),
    }
    for c in FIRST_NON_EMPTY:
        rules[c] = (c, F.col(c) != "")
    return rules


def keyed_listings(listings: DataFrame) -> DataFrame:
    """Listings with a non-empty name, with their name key (possibly empty).

    Rows whose key is empty are removed after aggregation by a flag computed
    in the aggregate. Filtering on the key before the aggregation would let
    the optimizer push the filter below the projection and evaluate the
    regex-heavy key twice per row; the empty-key group costs one partial row
    per task instead, so it cannot become a hot group either."""
    l = conform_listings(listings).where(F.col("name") != "")
    return l.withColumn("name_key", name_key("name"))


def fold_sources(first_seen: Column) -> Column:
    """Fold an array<struct<o,source>> sorted by o into the ', '-joined text:
    start with the first source; append a later one unless it is empty or
    already a substring; strip ',' and ' ' from both ends after appending."""
    return F.aggregate(
        F.slice(first_seen, 2, F.greatest(F.size(first_seen) - 1, F.lit(0))),
        first_seen.getItem(0).getField("source"),
        lambda acc, x: F.when((x.source == "") | (F.instr(acc, x.source) > 0), acc)
        .otherwise(F.btrim(F.concat(acc, F.lit(", "), x.source), F.lit(", "))))


def merge_listings(listings: DataFrame) -> DataFrame:
    rules = _rules()
    keyed = keyed_listings(listings)

    # every rule's candidate ord is computed once per row in a projection, so
    # the aggregation only compares ready columns
    values = sorted({v for v, _ in rules.values()})
    pre = keyed.select("name_key", "source", "ord", *values,
                       *[(F.col("ord") if cond is None else F.when(cond, F.col("ord"))).alias(f"{r}__o")
                         for r, (v, cond) in rules.items()])
    stage1 = [F.min("ord").alias("o"), F.max(F.col("name_key") != "").alias("_keyed")]
    for r, (v, cond) in rules.items():
        stage1 += [F.min(f"{r}__o").alias(f"{r}__o"), F.min_by(v, F.col(f"{r}__o")).alias(r)]
    per_source = pre.groupBy("name_key", "source").agg(*stage1)

    stage2 = [F.min("o").alias("first_ord"), F.max("_keyed").alias("_keyed"),
              F.array_sort(F.collect_list(F.struct("o", "source"))).alias("_srcs")]
    for r in rules:
        stage2.append(F.min_by(r, F.col(f"{r}__o")).alias(r))
    g = per_source.groupBy("name_key").agg(*stage2).where(F.col("_keyed"))

    phone = F.coalesce(F.col("phone_mobile"), F.col("phone_any"), F.lit(""))
    out = g.select(
        "name_key", "name",
        phone.alias("phone"),
        F.coalesce(F.col("website_http"), F.col("website_first")).alias("website"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in FIRST_NON_EMPTY],
        fold_sources(F.col("_srcs")).alias("sources"),
        "first_ord",
    )
    pt = classify_phone("phone")
    out = out.withColumn("phone_type", pt).withColumn(
        "type_rank", F.when(pt == "mobile", 0).when(pt == "landline", 1).otherwise(2))
    return out.select(*MERGED_COLUMNS)


def merged_in_order(merged: DataFrame) -> DataFrame:
    """Sink order of the merge: mobile, landline, none; then first appearance."""
    return merged.orderBy("type_rank", "first_ord")


def merge_summary(merged: DataFrame) -> DataFrame:
    """Run summary: total / mobile / landline / none."""
    return merged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("phone_type") == "mobile").alias("mobile"),
        F.count_if(F.col("phone_type") == "landline").alias("landline"),
    ).withColumn("no_phone", F.col("total") - F.col("mobile") - F.col("landline"))
