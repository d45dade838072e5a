"""Registered queries: one per operator group, each with a DuckDB oracle.

Every query reads the driver tables (or frames Spark derives from them) from
``sf_dir`` and returns a lazy DataFrame. Column names match the oracle text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle as O
from ..operators.merge import merge_listings, merge_summary
from ..sources.fixtures import fixture

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


FIRST_NON_EMPTY = ["address", "category", "company_size", "rating", "google_maps_url", "jobstreet_url", "hiredly_url"]


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------- merge

_KEYED = [("k", f"SELECT *, {O.name_key('name')} AS name_key, {O.phone_type('phone')} AS pt "
                "FROM listings WHERE name <> ''"),
          ("f", "SELECT * FROM k WHERE name_key <> ''")]
_MERGED = _KEYED + [
    ("s", "SELECT name_key, source, min(ord) AS o FROM f GROUP BY name_key, source"),
    ("src", "SELECT name_key, string_agg(source, ', ' ORDER BY o) AS sources FROM s GROUP BY name_key"),
    ("g", "SELECT name_key, min(ord) AS first_ord, arg_min(name, ord) AS name, "
          "coalesce(arg_min(phone, ord) FILTER (WHERE pt = 'mobile'), "
          "arg_min(phone, ord) FILTER (WHERE phone <> ''), '') AS phone, "
          "coalesce(arg_min(website, ord) FILTER (WHERE starts_with(website, 'http')), "
          "arg_min(website, ord)) AS website, "
          + ", ".join(f"coalesce(arg_min({c}, ord) FILTER (WHERE {c} <> ''), '') AS {c}"
                      for c in FIRST_NON_EMPTY)
          + " FROM f GROUP BY name_key"),
    ("merged", "SELECT g.name_key, g.name, g.phone, " + O.phone_type("g.phone") + " AS phone_type, "
               "g.website, " + ", ".join(f"g.{c}" for c in FIRST_NON_EMPTY) + ", src.sources, "
               "g.first_ord, CASE " + O.phone_type("g.phone") + " WHEN 'mobile' THEN 0 "
               "WHEN 'landline' THEN 1 ELSE 2 END AS type_rank "
               "FROM g JOIN src USING (name_key)"),
]


@register("merge_listings", O.with_fixtures(["listings"], "SELECT * FROM merged", _MERGED))
def q_merge_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_listings(fixture(spark, sf_dir, "listings"))


@register("merge_sources", O.with_fixtures(
    ["listings"], "SELECT name_key, sources, first_ord FROM merged", _MERGED))
def q_merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_merge_listings(spark, sf_dir).select("name_key", "sources", "first_ord")


@register("merge_summary", O.with_fixtures(
    ["listings"],
    "SELECT count(*) AS total, count(*) FILTER (WHERE phone_type = 'mobile') AS mobile, "
    "count(*) FILTER (WHERE phone_type = 'landline') AS landline, "
    "count(*) - count(*) FILTER (WHERE phone_type = 'mobile') "
    "- count(*) FILTER (WHERE phone_type = 'landline') AS no_phone FROM merged", _MERGED))
def q_merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_summary(q_merge_listings(spark, sf_dir))


# ---------------------------------------------------------------- columns

from ..functions import (classify_phone, clean_phone, is_valid_phone,  # noqa: E402
                         name_key, normalize_phone, TEXT_PHONE_RE)
from pyspark.sql import functions as F  # noqa: E402


@register("phone_columns", O.with_fixtures(
    ["listings"],
    "SELECT ord, phone, " + O.phone_type("phone") + " AS phone_type, "
    + O.clean_phone("phone") + " AS clean_phone, " + O.normalize_phone("phone")
    + " AS normalized_phone, " + O.valid_phone(O.normalize_phone("phone")) + " AS valid FROM listings"))
def q_phone_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = fixture(spark, sf_dir, "listings")
    return l.select("ord", "phone", classify_phone("phone").alias("phone_type"),
                    clean_phone("phone").alias("clean_phone"),
                    normalize_phone("phone").alias("normalized_phone"),
                    is_valid_phone(normalize_phone("phone")).alias("valid"))


@register("name_key", O.with_fixtures(
    ["listings"], "SELECT ord, name, " + O.name_key("name") + " AS name_key FROM listings"))
def q_name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = fixture(spark, sf_dir, "listings")
    return l.select("ord", "name", name_key("name").alias("name_key"))


@register("phone_valid", (
    "WITH m AS (SELECT doc_id, regexp_extract_all(text, " + O.q(O.TEXT_PHONE) + ", 1) AS ms "
    "FROM documents), h AS (SELECT doc_id, ms, unnest(range(len(ms))) AS pos FROM m) "
    "SELECT doc_id, CAST(pos AS INTEGER) AS pos, ms[pos + 1] AS raw, "
    + O.normalize_phone("ms[pos + 1]") + " AS normalized, "
    + O.valid_phone(O.normalize_phone("ms[pos + 1]")) + " AS valid FROM h"))
def q_phone_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone-shaped text in every document, normalised and validated."""
    from ..sources.tables import read_table
    d = read_table(spark, sf_dir, "documents")
    hits = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(TEXT_PHONE_RE), 1))
                    .alias("pos", "raw"))
    return hits.select("doc_id", "pos", "raw", normalize_phone("raw").alias("normalized"),
                       is_valid_phone(normalize_phone("raw")).alias("valid"))


# ---------------------------------------------------------------- dedupe

from ..operators.dedupe import dedupe_leads, dedupe_removed  # noqa: E402
from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources.csv_import import read_import_csv  # noqa: E402
from ..sources.key_index import build as build_keys, dedupe_committed, import_committed  # noqa: E402
from ..sources.leads import commit, fixture_leads, marks_after, newest_page, rewrite, scan_leads  # noqa: E402
from ..sources.search_index import build as build_postings, search_committed  # noqa: E402
from ..sources.summary import build as build_summary, counts as committed_counts  # noqa: E402

_DEDUPE = [O.LEADS_VIEW,
           ("dk", "SELECT *, " + O.name_key("name") + " AS name_key, "
                  "(CASE WHEN coalesce(phone, '') <> '' THEN 2 ELSE 0 END "
                  "+ CASE WHEN coalesce(website, '') <> '' THEN 1 ELSE 0 END "
                  "+ CASE WHEN coalesce(address, '') <> '' THEN 1 ELSE 0 END "
                  "+ CASE WHEN coalesce(category, '') <> '' THEN 1 ELSE 0 END "
                  "+ CASE WHEN coalesce(tags, '') <> '' THEN 1 ELSE 0 END) AS score FROM leads"),
           ("dr", "SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY score DESC, id) AS rn "
                  "FROM dk WHERE name_key <> ''")]
_LEAD_OUT = ("id, name, phone, phone_type, website, address, category, company_size, rating, "
             "sources, tags, notes, session_id, website_phone")


@register("dedupe_leads", O.with_fixtures(
    ["leads_raw"],
    f"SELECT {_LEAD_OUT} FROM dk WHERE name_key = '' UNION ALL SELECT {_LEAD_OUT} FROM dr WHERE rn = 1",
    _DEDUPE))
def q_dedupe_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_leads(fixture_leads(spark, sf_dir)).select(*[c.strip() for c in _LEAD_OUT.split(",")])


@register("dedupe_removed", O.with_fixtures(
    ["leads_raw"], "SELECT id, name_key FROM dr WHERE rn > 1", _DEDUPE))
def q_dedupe_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_removed(fixture_leads(spark, sf_dir))


@register("dedupe_committed", O.with_fixtures(
    ["leads_raw"],
    f"SELECT {_LEAD_OUT} FROM dk WHERE name_key = '' UNION ALL SELECT {_LEAD_OUT} FROM dr WHERE rn = 1",
    _DEDUPE))
def q_dedupe_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A committed table after de-duplication through its stored keys."""
    root = f"{ensure_checkpoint_dir(spark)}/leads-{uuid.uuid4().hex}"
    commit(fixture_leads(spark, sf_dir), root)
    build_keys(spark, root)
    dedupe_committed(spark, root)
    return scan_leads(spark, root).select(*[c.strip() for c in _LEAD_OUT.split(",")])


# ---------------------------------------------------------------- import (M1)

from ..operators.importer import import_counts, import_leads  # noqa: E402


def _strip_nan(x: str) -> str:
    s = O.py_strip(f"coalesce(CAST({x} AS VARCHAR), 'nan')")
    missing = ", ".join(O.q(m) for m in ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                                         "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"))
    return f"(CASE WHEN {s} = 'nan' OR {x} IN ({missing}) THEN '' ELSE {s} END)"


_IMPORT = [
    O.LEADS_VIEW,
    ("f0", "SELECT * FROM import_file"),
    ("c", "SELECT ord, " + _strip_nan("Company") + " AS name, "
          + _strip_nan("Phone") + " AS phone, " + _strip_nan("Website") + " AS website, "
          + _strip_nan("Address") + " AS address, " + _strip_nan("Industry") + " AS category FROM f0"),
    ("ck", "SELECT *, " + O.name_key("name") + " AS name_key FROM c WHERE name <> ''"),
    ("ex", "SELECT DISTINCT " + O.name_key("name") + " AS name_key FROM leads"),
    ("imp", "SELECT ord, name, phone, " + O.phone_type("phone") + " AS phone_type, website, address, "
            "category, 'imported' AS sources FROM ck WHERE ord IN (SELECT min(ord) FROM ck GROUP BY name_key) "
            "AND name_key NOT IN (SELECT name_key FROM ex)"),
]


@register("import_csv", O.with_fixtures(
    ["import_file"],
    "SELECT Company, Phone, Website, Address || chr(10) || 'Floor \"' || CAST(ord % 7 AS VARCHAR) || '\", ' || Company AS Address, Industry "
    "FROM import_file"))
def q_import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with line breaks and quotes in its cells, written from orders and
    read back."""
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    floor = F.concat(F.col("Address"), F.lit('\nFloor "'), (F.col("ord") % 7).cast("string"), F.lit('", '), F.col("Company"))
    rows = fixture(spark, sf_dir, "import_file").select("Company", "Phone", "Website", floor.alias("Address"), "Industry")
    rows.write.options(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_import_csv(spark, path).drop("ord").fillna("")


@register("import_leads", O.with_fixtures(["leads_raw", "import_file"], "SELECT * FROM imp", _IMPORT))
def q_import_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_leads(fixture(spark, sf_dir, "import_file"), fixture_leads(spark, sf_dir))


@register("import_committed", O.with_fixtures(["leads_raw", "import_file"], "SELECT * FROM imp", _IMPORT))
def q_import_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same import against a committed table, through its stored keys."""
    root = f"{ensure_checkpoint_dir(spark)}/leads-{uuid.uuid4().hex}"
    commit(fixture_leads(spark, sf_dir), root)
    build_keys(spark, root)
    return import_committed(spark, root, fixture(spark, sf_dir, "import_file"))


@register("import_counts", O.with_fixtures(
    ["leads_raw", "import_file"],
    "SELECT (SELECT count(*) FROM imp) AS imported, "
    "(SELECT count(*) FROM f0) - (SELECT count(*) FROM imp) AS skipped", _IMPORT))
def q_import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_counts(fixture(spark, sf_dir, "import_file"), fixture_leads(spark, sf_dir))


# ---------------------------------------------------------------- blocklist, filters, views

from ..operators import filters as FL  # noqa: E402
from ..sources.blocklist import entries_frame, setting_pattern  # noqa: E402

# Example blocklist setting used by the registered query (user configuration;
# blank entries, entries with regex characters and a trailing blank).
EXAMPLE_BLOCKLIST = '["tesla", "  ", "a&w ", "b.i.g.", "% arabica", "dôme", "ey ", "firm 99 sdn bhd"]'
_BL_DUCK = r"(?i)(tesla|a&w|b\.i\.g\.|% arabica|dôme|ey|firm 99 sdn bhd)"


@register("blocklist_filter", O.with_fixtures(
    ["listings"],
    "SELECT ord, source, name FROM listings WHERE NOT (source = 'google_maps' AND "
    "regexp_matches(coalesce(name, ''), " + O.q(_BL_DUCK) + "))"))
def q_blocklist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = fixture(spark, sf_dir, "listings")
    return FL.not_blocked(l, setting_pattern(spark, EXAMPLE_BLOCKLIST)).select("ord", "source", "name")


@register("blocklist_join", O.with_fixtures(
    ["listings", "blocklist_settings"],
    "SELECT ord, source, name FROM listings l WHERE source <> 'google_maps' OR NOT EXISTS (SELECT 1 FROM be WHERE be.e <> '' AND contains(lower(l.name), be.e))",
    [("be", "SELECT DISTINCT lower(trim(unnest(CAST(CAST(value AS JSON) AS VARCHAR[])))) AS e FROM blocklist_settings WHERE value IS NOT NULL")]))
def q_blocklist_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that no entry of any stored blocklist setting blocks."""
    entries = entries_frame(fixture(spark, sf_dir, "blocklist_settings"))
    return FL.not_blocked_by(fixture(spark, sf_dir, "listings"), entries).select("ord", "source", "name")


@register("newest_page", O.with_fixtures(
    ["leads_raw"], "SELECT id, name, sources FROM leads_raw WHERE id < 2000000100 ORDER BY id DESC LIMIT 250"))
def q_newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of the committed table, newest first, below a given id."""
    root = f"{ensure_checkpoint_dir(spark)}/leads-{uuid.uuid4().hex}"
    commit(fixture_leads(spark, sf_dir), root)
    return newest_page(spark, root, 250, before=2000000100).select("id", "name", "sources")


@register("blocklist_entries", O.with_fixtures(
    ["blocklist_settings"],
    "SELECT owner, CAST(i AS INTEGER) AS pos, e[i + 1] AS entry FROM (SELECT *, unnest(range(len(e))) AS i FROM "
    "(SELECT owner, list_transform(CAST(CAST(value AS JSON) AS VARCHAR[]), lambda x: trim(x)) AS e "
    "FROM blocklist_settings WHERE value IS NOT NULL)) WHERE e[i + 1] <> ''"))
def q_blocklist_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of every stored blocklist setting."""
    return entries_frame(fixture(spark, sf_dir, "blocklist_settings"))


SEARCH_EXAMPLE = "Firm 12|No 4, Bangsar"
_SEARCH_DUCK = "(" + " OR ".join(
    f"coalesce(regexp_matches(lower({c}), {O.q(SEARCH_EXAMPLE.lower())}), false)"
    for c in ["name", "phone", "address", "category", "website", "tags", "notes"]) + ")"
_VIEW_COLS = ("id, name, phone, phone_type, website_phone, website_phone2, website, address, category, tags, sources")


@register("search_leads", O.with_fixtures(
    ["leads_raw"], f"SELECT {_VIEW_COLS} FROM leads WHERE {_SEARCH_DUCK}", [O.LEADS_VIEW]))
def q_search_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.project(FL.search(fixture_leads(spark, sf_dir), SEARCH_EXAMPLE))


@register("search_committed", O.with_fixtures(
    ["leads_raw"], f"SELECT {_VIEW_COLS} FROM leads WHERE {_SEARCH_DUCK}", [O.LEADS_VIEW]))
def q_search_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over a committed table, through its posting table."""
    root = f"{ensure_checkpoint_dir(spark)}/leads-{uuid.uuid4().hex}"
    commit(fixture_leads(spark, sf_dir), root)
    build_postings(spark, root)
    return FL.project(search_committed(spark, root, SEARCH_EXAMPLE))


_NO_PHONE_DUCK = "(phone IS NULL OR " + O.py_strip("phone") + " = '')"


_COUNTED = [("mobile", "phone_type = 'mobile'"), ("landline", "phone_type = 'landline'"), ("no_phone", _NO_PHONE_DUCK)]


@register("committed_counts", O.with_fixtures(
    ["leads_raw"],
    "SELECT 'lead' AS kind, '' AS name, count(*) AS n FROM kept HAVING count(*) > 0 "
    + "".join(f"UNION ALL SELECT '{k}', '', count(*) FROM kept WHERE {c} HAVING count(*) > 0 " for k, c in _COUNTED)
    + "UNION ALL SELECT 'session', CAST(session_id AS VARCHAR), count(*) FROM kept WHERE session_id IS NOT NULL GROUP BY session_id "
    + "UNION ALL SELECT 'source', s, count(DISTINCT id) FROM (SELECT id, " + O.py_strip("part") + " AS s FROM "
      "(SELECT id, unnest(string_split(sources, ',')) AS part FROM kept)) WHERE s <> '' GROUP BY s",
    [O.LEADS_VIEW, ("kept", "SELECT * FROM leads WHERE session_id IS DISTINCT FROM 3")]))
def q_committed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, facets and sessions of a committed table after a session was
    deleted, from its stored summaries."""
    root = f"{ensure_checkpoint_dir(spark)}/leads-{uuid.uuid4().hex}"
    commit(fixture_leads(spark, sf_dir), root)
    build_summary(spark, root)
    rewrite(spark, root, F.col("session_id") == 3, lambda leads: leads.where(~F.col("session_id").eqNullSafe(F.lit(3))))
    build_summary(spark, root)
    return committed_counts(spark, root)


@register("phone_filter", O.with_fixtures(
    ["leads_raw"],
    "SELECT 'mobile' AS mode, id FROM leads WHERE phone_type = 'mobile' UNION ALL "
    "SELECT 'landline', id FROM leads WHERE phone_type = 'landline' UNION ALL "
    f"SELECT 'has_phone', id FROM leads WHERE NOT {_NO_PHONE_DUCK} UNION ALL "
    f"SELECT 'no_phone', id FROM leads WHERE {_NO_PHONE_DUCK}", [O.LEADS_VIEW]))
def q_phone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.phone_modes(fixture_leads(spark, sf_dir))


@register("source_filter", O.with_fixtures(
    ["listings"], "SELECT name_key, sources FROM merged WHERE contains(sources, 'jobstreet')", _MERGED))
def q_source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.source_filter(q_merge_listings(spark, sf_dir), "jobstreet").select("name_key", "sources")


@register("tag_filter", O.with_fixtures(
    ["leads_raw"], "SELECT id, tags FROM leads WHERE contains(tags, 'called')", [O.LEADS_VIEW]))
def q_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.tag_filter(fixture_leads(spark, sf_dir), "called").select("id", "tags")


@register("view_stats", O.with_fixtures(
    ["leads_raw"],
    "SELECT count(*) AS showing, count(*) FILTER (WHERE phone_type = 'mobile') AS mobile, "
    "count(*) FILTER (WHERE phone_type = 'landline') AS landline, "
    f"count(*) FILTER (WHERE {_NO_PHONE_DUCK}) AS no_phone FROM leads WHERE {_SEARCH_DUCK} "
    "AND contains(sources, 'google_maps') AND contains(tags, 'called')", [O.LEADS_VIEW]))
def q_view_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = FL.view(fixture_leads(spark, sf_dir), SEARCH_EXAMPLE, "all", "google_maps", "called")
    return FL.view_stats(v)


@register("source_facets", O.with_fixtures(
    ["listings"],
    "SELECT DISTINCT " + O.py_strip("s") + " AS source FROM (SELECT unnest(string_split(sources, ',')) AS s "
    "FROM merged) WHERE " + O.py_strip("s") + " <> ''", _MERGED))
def q_source_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.source_facets(q_merge_listings(spark, sf_dir))


@register("lead_count", O.with_fixtures(["leads_raw"], "SELECT count(*) AS leads FROM leads_raw"))
def q_lead_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.lead_count(fixture_leads(spark, sf_dir))


# ---------------------------------------------------------------- sessions, edits, tags, save, export

from ..operators import mutations as MU  # noqa: E402
from ..sources.leads import FIXTURE_AS_OF  # noqa: E402

EDIT_AS_OF = "2026-02-01 00:00:00"


@register("session_leads", O.with_fixtures(
    ["leads_raw"], "SELECT id, " + "name, phone, phone_type, website, address, category" + " FROM leads WHERE session_id = 3",
    [O.LEADS_VIEW]))
def q_session_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MU.session_detail(fixture_leads(spark, sf_dir), 3)


@register("session_list", O.with_fixtures(
    ["leads_raw", "sessions_raw"],
    "SELECT s.id, s.sources, s.query_info, s.result_count, coalesce(c.n, 0) AS current_count "
    "FROM sessions_raw s LEFT JOIN (SELECT session_id, count(*) AS n FROM "
    f"(SELECT {_LEAD_OUT} FROM dk WHERE name_key = '' UNION ALL SELECT {_LEAD_OUT} FROM dr WHERE rn = 1) "
    "WHERE session_id IS NOT NULL GROUP BY session_id) c ON c.session_id = s.id", _DEDUPE))
def q_session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, newest first, with the stored count next to the count left
    after de-duplication."""
    leads = fixture_leads(spark, sf_dir)
    sessions = fixture(spark, sf_dir, "sessions_raw")
    return MU.current_counts(sessions, dedupe_leads(leads)).select(
        "id", "sources", "query_info", "result_count", "current_count")


@register("sessions_newest", O.with_fixtures(
    ["leads_raw", "sessions_raw"],
    "SELECT id, sources, query_info, result_count FROM sessions_raw ORDER BY id DESC"))
def q_sessions_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = fixture(spark, sf_dir, "sessions_raw").withColumn("created_at", F.lit(FIXTURE_AS_OF))
    return MU.list_sessions(sessions).select("id", "sources", "query_info", "result_count")


@register("delete_session", O.with_fixtures(
    ["leads_raw"], "SELECT id, session_id FROM leads_raw WHERE session_id IS DISTINCT FROM 2"))
def q_delete_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = fixture_leads(spark, sf_dir)
    sessions = fixture(spark, sf_dir, "sessions_raw")
    kept, _, _ = MU.delete_session(leads, sessions, 2)
    return kept.select("id", "session_id")


_TAG_VIEW = "(" + " OR ".join(f"coalesce(regexp_matches(lower({c}), 'bangsar'), false)"
                              for c in ["name", "phone", "address", "category", "website", "tags",
                                        "notes"]) + ")"


@register("bulk_tag", O.with_fixtures(
    ["leads_raw"],
    f"SELECT id, CASE WHEN {_TAG_VIEW} AND NOT contains(tags, 'call') THEN trim(tags || ', call', ', ') "
    f"ELSE tags END AS tags, ({_TAG_VIEW} AND NOT contains(tags, 'call')) AS changed FROM leads",
    [O.LEADS_VIEW]))
def q_bulk_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag every lead of the 'bangsar' view with 'call' ('called' counts as
    present: substring test)."""
    leads = fixture_leads(spark, sf_dir)
    out = MU.bulk_tag(leads, "call", EDIT_AS_OF, mask=FL.search_mask("bangsar", present=leads.columns))
    return out.select("id", "tags", F.col("_changed").alias("changed"))


_EDITS = [O.LEADS_VIEW,
          ("e", "SELECT * FROM edits WHERE id IS NOT NULL"),
          ("le", "SELECT e.id, coalesce(e.phone, '') AS phone, coalesce(e.notes, '') AS notes FROM e "
                 "JOIN (SELECT id, max(ord) AS ord FROM e GROUP BY id) m ON m.id = e.id AND m.ord = e.ord")]


@register("apply_edits", O.with_fixtures(
    ["leads_raw", "edits"],
    "SELECT l.id, CASE WHEN le.id IS NULL THEN l.phone ELSE le.phone END AS phone, l.phone_type, "
    "CASE WHEN le.id IS NULL THEN l.notes ELSE le.notes END AS notes, l.website_phone2, "
    "le.id IS NOT NULL AS updated FROM leads l LEFT JOIN le ON le.id = l.id", _EDITS))
def q_apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = fixture_leads(spark, sf_dir)
    out = MU.apply_edits(leads, fixture(spark, sf_dir, "edits"), EDIT_AS_OF)
    return out.select("id", "phone", "phone_type", "notes", "website_phone2",
                      (F.col("updated_at") != F.col("created_at")).alias("updated"))


@register("edit_snapshot", O.with_fixtures(
    ["leads_raw", "edits"],
    "SELECT l.id, l.name, CASE WHEN le.id IS NULL THEN l.phone ELSE le.phone END AS phone, "
    "CASE WHEN le.id IS NULL THEN l.notes ELSE le.notes END AS notes, CASE WHEN contains(l.tags, 'seen') OR l.id % 2 = 1 THEN l.tags "
    "WHEN l.tags = '' THEN 'seen' ELSE l.tags || ', seen' END AS tags, l.session_id FROM leads l LEFT JOIN le ON le.id = l.id "
    "WHERE l.session_id IS DISTINCT FROM 3", _EDITS))
def q_edit_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A committed table after an edit batch, a bulk tag and a deleted session,
    each a rewrite of the buckets it touches, read back."""
    root = f"{ensure_checkpoint_dir(spark)}/leads-{uuid.uuid4().hex}"
    commit(fixture_leads(spark, sf_dir), root)
    edits = fixture(spark, sf_dir, "edits")
    rewrite(spark, root, edits, lambda leads: MU.apply_edits(leads, edits, EDIT_AS_OF))
    even = F.col("id") % 2 == 0
    rewrite(spark, root, even, lambda leads: MU.bulk_tag(leads, "seen", EDIT_AS_OF, mask=even).drop("_changed"))
    rewrite(spark, root, F.col("session_id") == 3, lambda leads: leads.where(~F.col("session_id").eqNullSafe(F.lit(3))))
    return scan_leads(spark, root).select("id", "name", "phone", "notes", "tags", "session_id")


@register("edit_count", O.with_fixtures(
    ["edits"], "SELECT count(*) FILTER (WHERE id IS NOT NULL) AS edited FROM edits"))
def q_edit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MU.edit_count(fixture(spark, sf_dir, "edits"))


_TAGS = [("已打電話", "#3B82F6"), ("有興趣", "#10B981"), ("不要再打", "#EF4444"), ("待跟進", "#F59E0B"), ("重要客戶", "#8B5CF6")]
_DEFAULT_TAGS_SQL = " UNION ALL ".join(
    f"SELECT {i + 1} AS id, {O.q(n)} AS name, {O.q(c)} AS color" for i, (n, c) in enumerate(_TAGS))


@register("add_tags", O.with_fixtures(
    ["leads_raw"],
    "SELECT CAST(id AS BIGINT) AS id, name, color FROM d UNION ALL "
    f"SELECT CAST({len(_TAGS)} + row_number() OVER (ORDER BY name) AS BIGINT), name, '#6B7280' FROM n",
    [("d", _DEFAULT_TAGS_SQL),
     ("n", "SELECT DISTINCT trim(t) AS name FROM (SELECT unnest(string_split(tags, ',')) AS t FROM leads_raw) "
           "WHERE trim(t) <> '' AND trim(t) NOT IN (SELECT name FROM d)")]))
def q_add_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed the default tags, then add every tag name used on a lead."""
    leads = fixture_leads(spark, sf_dir)
    tags = MU.seed_tags(spark, None, FIXTURE_AS_OF)
    used = leads.select(F.explode(F.split("tags", ",")).alias("name"))
    return MU.add_tags(tags, used, EDIT_AS_OF).select("id", "name", "color")


@register("save_listings", O.with_fixtures(
    ["listings", "leads_raw"],
    "SELECT CAST((SELECT max(id) FROM leads_raw) + row_number() OVER (ORDER BY type_rank, first_ord) AS BIGINT) "
    "AS id, name, phone, phone_type, sources, CAST(5 AS BIGINT) AS session_id FROM merged", _MERGED))
def q_save_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged listings appended to the leads table as session 5 (new rows)."""
    leads = fixture_leads(spark, sf_dir)
    merged = merge_listings(fixture(spark, sf_dir, "listings"))
    new = MU.listings_as_leads(merged, 5, MU.next_id(leads), EDIT_AS_OF)
    return new.select("id", "name", "phone", "phone_type", "sources", "session_id")


@register("save_after_delete", O.with_fixtures(
    ["listings", "leads_raw"],
    "SELECT CAST((SELECT max(id) FROM leads_raw) + row_number() OVER (ORDER BY type_rank, first_ord) AS BIGINT) AS id, "
    "name, CAST(6 AS BIGINT) AS session_id FROM merged UNION ALL "
    "SELECT id, name, session_id FROM leads_raw WHERE session_id IS DISTINCT FROM 0", _MERGED))
def q_save_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete the session that holds the newest lead, then save a run: the
    deleted ids are not given out again."""
    leads = fixture_leads(spark, sf_dir)
    marks = marks_after(None, leads=leads)
    kept, _, _ = MU.delete_session(leads, fixture(spark, sf_dir, "sessions_raw"), 0)
    merged = merge_listings(fixture(spark, sf_dir, "listings"))
    return MU.save_listings(kept, merged, 6, EDIT_AS_OF, marks["leads"]).select("id", "name", "session_id")


_EXPORT = ["name", "phone", "phone_type", "website_phone", "website", "address", "category", "company_size", "tags"]


@register("export_leads", O.with_fixtures(
    ["leads_raw"], "SELECT " + ", ".join(_EXPORT) + f" FROM leads WHERE NOT {_NO_PHONE_DUCK}", [O.LEADS_VIEW]))
def q_export_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MU.export_view(fixture_leads(spark, sf_dir), "has_phone")


# ---------------------------------------------------------------- links (L1-L4)

from ..operators import links as LK  # noqa: E402


def _anchor_rows(src: str, keep: str) -> list[tuple[str, str]]:
    """Oracle CTEs ea_<src>: one row per anchor with pos, attrs, inner, href."""
    return [
        (f"a_{src}", f"SELECT {keep}, " + O.extract_all(O.markup("html"), O.ANCHOR, 1) + " AS atts, "
                     + O.extract_all(O.markup("html"), O.ANCHOR, 2) + f" AS inn FROM {src}"),
        (f"i_{src}", f"SELECT *, unnest(range(len(atts))) AS i FROM a_{src}"),
        (f"ea_{src}", f"SELECT {keep}, CAST(i AS INTEGER) AS pos, atts[i + 1] AS attrs, inn[i + 1] AS inr, "
                      + O.attr("atts[i + 1]", "href") + f" AS href FROM i_{src}"),
    ]


def _contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {O.q(w)})" for w in words) + ")"


_RP = _anchor_rows("result_pages", "kind, source, seed_no, page_no")


@register("place_links", O.with_fixtures(
    ["result_pages"],
    "SELECT href, seed_no, page_no, pos FROM (SELECT *, row_number() OVER (PARTITION BY href "
    "ORDER BY seed_no, page_no, pos) AS rn FROM ea_result_pages WHERE kind = 'maps_results' "
    "AND contains(href, '/maps/place/')) WHERE rn = 1", _RP))
def q_place_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fixture(spark, sf_dir, "result_pages").where(F.col("kind") == "maps_results")
    return LK.place_links(pages).select("href", "seed_no", "page_no", "pos")


_DIR_A_NAME = O.clean_line(O.inner_text("inr"))


@register("directory_links", O.with_fixtures(
    ["result_pages"],
    "SELECT name, url, seed_no, page_no, pos FROM (SELECT *, row_number() OVER (PARTITION BY url "
    "ORDER BY seed_no, page_no, pos) AS rn FROM (SELECT *, split_part(CASE WHEN starts_with(href, 'http') "
    f"THEN href ELSE 'https://my.jobstreet.com' || href END, '?', 1) AS url, {_DIR_A_NAME} AS name "
    "FROM ea_result_pages WHERE source = 'jobstreet' AND contains(href, '/companies/')) "
    "WHERE lower(name) NOT IN (" + ", ".join(O.q(s) for s in ("write a review", "sign in", "employer site", "companies", "community", "")) + ") "
    "AND length(name) >= 2 AND NOT contains(href, '/companies?')) WHERE rn = 1", _RP))
def q_directory_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fixture(spark, sf_dir, "result_pages").where(F.col("source") == "jobstreet")
    return LK.directory_a_links(pages)


@register("directory_b_links", O.with_fixtures(
    ["result_pages"],
    "SELECT url, seed_no, page_no, pos FROM (SELECT *, row_number() OVER (PARTITION BY url "
    "ORDER BY seed_no, page_no, pos) AS rn FROM (SELECT *, CASE WHEN starts_with(href, 'http') THEN href "
    f"ELSE 'https://my.hiredly.com' || href END AS url FROM ea_result_pages WHERE source = 'hiredly' "
    "AND contains(href, '/companies/') AND NOT contains(href, '/companies?'))) WHERE rn = 1", _RP))
def q_directory_b_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fixture(spark, sf_dir, "result_pages").where(F.col("source") == "hiredly")
    return LK.directory_b_links(pages)


_HOME = [("home", "SELECT * FROM site_pages WHERE kind = 'site_home'")] + _anchor_rows("home", "company_id, url")
_CT = "lower(" + O.inner_text("inr") + ")"


def _resolve_sql(base: str, h: str) -> str:
    scheme = f"regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*):', 1)"
    org = f"regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1)"
    no_frag = f"regexp_replace({base}, '#.*$', '')"
    no_query = f"regexp_replace({no_frag}, '\\?.*$', '')"
    pdir = f"regexp_extract({no_query}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*(?:/[^?#]*/)?)', 1)"
    d = f"(CASE WHEN ends_with({pdir}, '/') THEN {pdir} ELSE {pdir} || '/' END)"
    return (f"(CASE WHEN regexp_matches({h}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN {h} WHEN {h} = '' THEN {base} "
            f"WHEN starts_with({h}, '//') THEN {scheme} || ':' || {h} WHEN starts_with({h}, '/') THEN {org} || {h} "
            f"WHEN starts_with({h}, '?') THEN {no_query} || {h} WHEN starts_with({h}, '#') THEN {no_frag} || {h} "
            f"ELSE {d} || {h} END)")


_CONTACT_OK = ("(" + _contains_any("href", ["contact", "Contact", "about-us", "hubungi"]) + " OR "
               + _contains_any(_CT, ["contact", "hubungi"]) + ") AND NOT "
               + _contains_any("lower(href)", ["facebook", "linkedin", "twitter", "instagram", "youtube", "tiktok",
                                               "whatsapp", "mailto:", "tel:"]) + " AND ("
               + _contains_any(_CT, ["contact", "hubungi", "reach"])
               + " OR " + _contains_any("lower(href)", ["contact", "hubungi"]) + ")")


@register("contact_links", O.with_fixtures(
    ["site_pages"],
    "SELECT company_id, pos, href, CASE WHEN href = '' THEN NULL WHEN starts_with(href, 'http') THEN href "
    "ELSE " + _resolve_sql("url", "href") + " END AS contact_url FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY company_id ORDER BY pos) AS rn FROM ea_home WHERE {_CONTACT_OK}) WHERE rn = 1", _HOME))
def q_contact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = fixture(spark, sf_dir, "site_pages").where(F.col("kind") == "site_home")
    return LK.contact_links(home)


# ---------------------------------------------------------------- detail pages

from ..operators import extract as EX  # noqa: E402
from ..sources.tables import read_table  # noqa: E402


def _lines_sql(x: str) -> str:
    return f"list_transform(string_split({O.blank(x)}, chr(10)), lambda x: {O.clean_line('x')})"


@register("body_lines", (
    "SELECT doc_id, CAST(i AS INTEGER) AS line_no, ls[i + 1] AS line FROM (SELECT doc_id, ls, "
    f"unnest(range(len(ls))) AS i FROM (SELECT doc_id, {_lines_sql('text')} AS ls FROM documents))"))
def q_body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cleaned line of every document."""
    return EX.lines_table(read_table(spark, sf_dir, "documents"))


@register("page_titles_as_names", (
    f"SELECT page_id, {O.first_h1('html')} AS name FROM pages WHERE {O.first_h1('html')} <> ''"))
def q_page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EX.page_titles(read_table(spark, sf_dir, "pages"))


def _label_sql(a: str, b: str) -> str:
    aria = O.attr(a, "aria-label")
    return f"(CASE WHEN {aria} <> '' THEN {aria} ELSE {O.inner_text(b)} END)"


_PLACE = [
    ("pa", "SELECT page_id, url, html, " + O.extract_all(O.markup("html"), O.ANCHOR, 1) + " AS aat, "
           + O.extract_all(O.markup("html"), O.ANCHOR, 2) + " AS ain, " + O.extract_all(O.markup("html"), O.BUTTON, 1)
           + " AS bat, " + O.extract_all(O.markup("html"), O.BUTTON, 2) + " AS bin FROM place_pages"),
    ("pb", "SELECT *, list_filter(aat, lambda x: starts_with(" + O.attr("x", "href") + ", 'tel:')) AS tel, "
           "list_filter(list_transform(list_filter(range(1, len(bat) + 1), lambda i: contains("
           + O.attr("bat[i]", "data-item-id") + ", 'phone')), lambda i: regexp_extract("
           + _label_sql("bat[i]", "bin[i]") + ", " + O.q(O.BUTTON_PHONE) + ", 1)), lambda m: m <> '') AS hits, "
           "list_filter(aat, lambda x: " + O.attr("x", "data-item-id") + " = 'authority') AS auth, "
           "list_filter(bat, lambda x: " + O.attr("x", "data-item-id") + " = 'address') AS addr, "
           "list_filter(range(1, len(bat) + 1), lambda i: contains(" + O.attr("bat[i]", "jsaction")
           + ", 'category')) AS cat FROM pa"),
    ("pc", "SELECT page_id, url, " + O.first_h1("html") + " AS name, CASE WHEN len(tel) > 0 THEN "
           + O.clean_phone("replace(" + O.attr("tel[1]", "href") + ", 'tel:', '')") + " ELSE "
           + O.clean_phone("hits[1]") + " END AS phone, "
           "CASE WHEN len(auth) > 0 THEN " + O.attr("auth[1]", "href") + " ELSE '' END AS website, "
           "CASE WHEN len(addr) > 0 THEN replace(" + O.attr("addr[1]", "aria-label") + ", 'Address: ', '') "
           "ELSE '' END AS address, CASE WHEN len(cat) > 0 THEN " + O.inner_text("bin[cat[1]]")
           + " ELSE '' END AS category, " + O.inner_text(f"regexp_extract(html, {O.q(O.RATING)}, 1)")
           + " AS rating FROM pb"),
]


@register("place_details", O.with_fixtures(
    ["place_pages"],
    "SELECT *, CASE WHEN phone <> '' THEN " + O.phone_type("phone") + " ELSE '' END AS phone_type "
    "FROM pc WHERE name <> ''", _PLACE))
def q_place_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EX.place_details(fixture(spark, sf_dir, "place_pages"))


_LABELS = [("Website", "website", 200), ("Industry", "category", 200), ("Company size", "company_size", 100),
           ("Primary location", "address", 300)]


def _label_field(label: str, limit: int) -> str:
    idx = (f"list_filter(range(1, len(ls)), lambda i: ls[i] = {O.q(label)} AND ls[i + 1] <> '' "
           f"AND length(ls[i + 1]) < {limit})[-1]")
    return f"coalesce(ls[{idx} + 1], '')"


@register("label_fields", O.with_fixtures(
    ["dir_a_pages"],
    "SELECT page_id, " + ", ".join(f"{_label_field(lbl, lim)} AS {fld}" for lbl, fld, lim in _LABELS)
    + f" FROM (SELECT page_id, {_lines_sql('body_text')} AS ls FROM dir_a_pages)"))
def q_label_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EX.label_fields(fixture(spark, sf_dir, "dir_a_pages"))


_SKIP_LIST = "[" + ", ".join(O.q(s) for s in ("Companies", "Log In", "Sign Up", "For Employers", "Jobs Search", "Internships", "Drop Resume", "English")) + "]"
_SITE_OK = " AND ".join(["starts_with(h, 'http')"] + [f"NOT contains(h, {O.q(b)})" for b in ("hiredly", "google", "facebook", "linkedin", "twitter", "instagram", "youtube", "tiktok")])
_PROFILE = [
    ("d", f"SELECT page_id, html, list_filter({_lines_sql('body_text')}, lambda x: length(x) > 1) AS ls "
          "FROM dir_b_pages"),
    ("n", f"SELECT *, coalesce(list_filter(ls, lambda x: NOT list_contains({_SKIP_LIST}, x) AND length(x) > 2 "
          "AND length(x) < 100)[1], '') AS name, list_position(ls, 'Our Address') AS ap FROM d"),
    ("pr", "SELECT page_id, name, coalesce(CASE WHEN list_position(ls, name) > 0 THEN list_filter("
           "ls[list_position(ls, name) + 1:], lambda x: x <> name AND length(x) < 80 AND NOT ends_with(x, 'jobs'))[1] "
           "END, '') AS category, coalesce(CASE WHEN ap > 0 AND ap < len(ls) THEN list_filter(ls[ap + 1:ap + 4], "
           "lambda x: length(x) > 10)[1] END, '') AS address, coalesce(list_filter(list_transform(list_filter("
           + O.extract_all(O.markup("html"), O.ANCHOR, 1) + ", lambda a: " + O.attr("a", "href") + " <> ''), lambda a: "
           + O.attr("a", "href") + f"), lambda h: {_SITE_OK})[1], '') AS website FROM n"),
]


@register("company_profile", O.with_fixtures(
    ["dir_b_pages"], "SELECT * FROM pr WHERE name <> ''", _PROFILE))
def q_company_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EX.company_profile(fixture(spark, sf_dir, "dir_b_pages"))


# ---------------------------------------------------------------- website phones

from ..operators import verify as VF  # noqa: E402

_P = O.q(O.TEXT_PHONE)
_CHAT = ["wa.me", "whatsapp", "wasap"]


@register("website_candidates", O.with_fixtures(
    ["leads_raw"],
    "SELECT id, name, phone, website, website_phone FROM leads_raw WHERE lower(website) LIKE 'http%' "
    "AND coalesce(website_phone, '') = ''"))
def q_website_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VF.website_candidates(fixture_leads(spark, sf_dir), "unverified")


def _offset_hits(src: str, key: str, text: str) -> list[tuple[str, str]]:
    """Oracle text-phone hits with context windows, from split offsets."""
    return [
        (f"m_{src}", f"SELECT {key}, {text} AS t, regexp_extract_all({text}, {_P}) AS m, "
                     f"regexp_split_to_array({text}, {_P}) AS sp FROM {src}"),
        (f"u_{src}", f"SELECT *, unnest(range(len(m))) AS i FROM m_{src}"),
        (f"o_{src}", f"SELECT *, list_sum(list_transform(sp[1:i + 1], lambda x: length(x))) "
                     f"+ coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS st FROM u_{src}"),
        (f"w_{src}", f"SELECT {key}, CAST(i AS INTEGER) AS pos, m[i + 1] AS raw, substring(t, "
                     f"CAST(greatest(st - {O.BEFORE}, 0) + 1 AS INTEGER), CAST(least(st + length(m[i + 1]) "
                     f"+ {O.AFTER}, length(t)) - greatest(st - {O.BEFORE}, 0) AS INTEGER)) AS context "
                     f"FROM o_{src}"),
    ]


@register("text_phones", (
    "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in _offset_hits("documents", "doc_id", "coalesce(text, '')"))
    + "\nSELECT doc_id, pos, raw, context FROM w_documents"))
def q_text_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text phones of every document with their 60-before / 20-after windows."""
    return VF.text_phones(read_table(spark, sf_dir, "documents"))


def _site_phone_ctes(pages: str) -> list[tuple[str, str]]:
    """Oracle CTEs: hits (V3-V5) -> per page (V6) -> per company (V7) as cp."""
    chat_hint = " OR ".join(f"contains(href, {O.q(h)})" for h in _CHAT)
    body = f"coalesce(body_text, {O.strip_tags(O.markup('html'))})"
    return [
        # the open elements before every tag, one tag a round: void elements never open, an item closes the open item
        ("tk", f"SELECT company_id, page_ord, regexp_extract({O.markup('html')}, '^[^<]*') AS before, "
               f"regexp_extract_all({O.markup('html')}, '(?s)</?[a-zA-Z][^>]*>[^<]*') AS toks FROM {pages}"),
        ("wk", "SELECT company_id, page_ord, toks, 0 AS i, CAST([0] AS BIGINT[]) AS st FROM tk UNION ALL "
               "SELECT company_id, page_ord, toks, i + 1, CASE "
               "WHEN starts_with(toks[i + 1], '</ul') THEN list_filter(st, lambda e: e < list_max(list_filter(st, lambda x: x > 0 AND starts_with(toks[x], '<ul')))) "
               "WHEN starts_with(toks[i + 1], '</') THEN st[1:len(st) - 1] "
               "WHEN starts_with(toks[i + 1], '<br') THEN st "
               "WHEN starts_with(toks[i + 1], '<li') AND starts_with(toks[st[len(st)]], '<li') THEN list_append(st[1:len(st) - 1], i + 1) "
               "ELSE list_append(st, i + 1) END FROM wk WHERE i < len(toks)"),
        ("pr", "SELECT w.company_id, w.page_ord, w.i, b.st[len(b.st)] AS parent FROM wk w JOIN wk b ON b.company_id = w.company_id "
               "AND b.page_ord = w.page_ord AND b.i = w.i - 1 WHERE regexp_matches(w.toks[w.i], '(?i)^<a[ >]') AND contains(w.toks[w.i], 'tel:')"),
        ("pe", "SELECT pr.company_id, pr.page_ord, pr.i, pr.parent, min(w.i) AS till FROM pr LEFT JOIN wk w ON w.company_id = pr.company_id "
               "AND w.page_ord = pr.page_ord AND w.i > pr.i AND NOT list_contains(w.st, pr.parent) GROUP BY ALL"),
        ("pt", "SELECT pe.*, tk.toks[pe.i] AS tok, CASE WHEN parent = 0 THEN before ELSE '' END || "
               "array_to_string(tk.toks[greatest(parent, 1):coalesce(till - 1, len(tk.toks))], '') AS around "
               "FROM pe JOIN tk ON tk.company_id = pe.company_id AND tk.page_ord = pe.page_ord"),
        ("tel", "SELECT company_id, page_ord, 1 AS strategy, CAST(i AS BIGINT) AS pos, replace(replace("
                + O.attr("tok", "href") + ", 'tel:', ''), '%20', '') AS raw, 'high' AS confidence FROM pt WHERE starts_with("
                + O.attr("tok", "href") + ", 'tel:') AND NOT regexp_matches(" + O.strip_tags("around") + f", {O.q(O.FAX)})"),
        ("sca", "SELECT company_id, page_ord, ai, " + O.attr("atts[ai + 1]", "href") + " AS href FROM (SELECT *, "
                "unnest(range(len(atts))) AS ai FROM (SELECT company_id, page_ord, "
                + O.extract_all(O.markup("html"), O.ANCHOR, 1) + f" AS atts FROM {pages}))"),
        ("chat", "SELECT * FROM (SELECT company_id, page_ord, 2 AS strategy, CAST(ai AS BIGINT) AS pos, "
                 f"regexp_extract(href, {O.q(O.CHAT_PHONE)}, 1) AS raw, 'high' AS confidence FROM sca "
                 f"WHERE {chat_hint}) WHERE raw <> ''"),
        ("sbody", f"SELECT company_id, page_ord, {body} AS body FROM {pages}"),
        *_offset_hits("sbody", "company_id, page_ord", "body"),
        ("txt", "SELECT company_id, page_ord, 3 AS strategy, CAST(pos AS BIGINT) AS pos, raw, "
                f"CASE WHEN regexp_matches(context, {O.q(O.NEAR)}) THEN 'medium' ELSE 'low' END AS confidence "
                f"FROM w_sbody WHERE NOT regexp_matches(context, {O.q(O.FAX)})"),
        ("hits", "SELECT company_id, page_ord, strategy, pos, " + O.normalize_phone("raw") + " AS phone, confidence "
                 "FROM (SELECT * FROM tel UNION ALL SELECT * FROM chat UNION ALL SELECT * FROM txt) WHERE "
                 + O.valid_phone(O.normalize_phone("raw"))),
        ("pp", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, page_ord, phone "
               "ORDER BY strategy, pos) AS rn FROM hits) WHERE rn = 1"),
        ("cp", "SELECT f.company_id, f.phone, CASE WHEN h.later_high THEN 'high' ELSE f.confidence END AS confidence, "
               "f.page_ord, f.strategy, f.pos FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "
               "company_id, phone ORDER BY page_ord, strategy, pos) AS r2 FROM pp) WHERE r2 = 1) f JOIN "
               "(SELECT company_id, phone, bool_or(page_ord > 1 AND confidence = 'high') AS later_high FROM pp "
               "GROUP BY company_id, phone) h ON h.company_id = f.company_id AND h.phone = f.phone"),
        ("rk", "SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY CASE confidence WHEN 'high' THEN 0 "
               "WHEN 'medium' THEN 1 ELSE 2 END, CASE " + O.phone_type("phone") + " WHEN 'mobile' THEN 0 ELSE 1 END, "
               "page_ord, strategy, pos) AS rk FROM cp"),
        ("b2", "SELECT company_id AS id, coalesce(max(phone) FILTER (WHERE rk = 1), '') AS website_phone, "
               "coalesce(max(" + O.phone_type("phone") + ") FILTER (WHERE rk = 1), '') AS website_phone_type, "
               "coalesce(max(phone) FILTER (WHERE rk = 2), '') AS website_phone2, "
               "coalesce(max(" + O.phone_type("phone") + ") FILTER (WHERE rk = 2), '') AS website_phone2_type, "
               "coalesce(max(confidence) FILTER (WHERE rk = 1), '') AS website_phone_source, "
               "string_agg(phone || ' (' || confidence || ')', ', ' ORDER BY rk) AS all_phones "
               "FROM rk GROUP BY company_id"),
    ]


@register("site_phones", O.with_fixtures(
    ["site_pages"], "SELECT company_id, phone, confidence, page_ord, strategy, pos FROM cp",
    _site_phone_ctes("site_pages")))
def q_site_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per company and number: confidence after the page and home/contact
    rules, and where it was first seen."""
    return VF.company_phones(fixture(spark, sf_dir, "site_pages"))


@register("best_two_phones", O.with_fixtures(["site_pages"], "SELECT * FROM b2", _site_phone_ctes("site_pages")))
def q_best_two_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = VF.best_two(VF.company_phones(fixture(spark, sf_dir, "site_pages")))
    return b.withColumn("all_phones", F.array_join("all_phones", ", "))


# Captured site pages of the customer-derived leads: lead id = 1e9 + customer key.
_LEAD_PAGES = ("lead_pages", "SELECT 1000000000 + company_id AS company_id, page_ord, kind, url, html, body_text "
                             "FROM site_pages")
_RESULTS = [O.LEADS_VIEW, _LEAD_PAGES,
            ("cand", "SELECT id FROM leads WHERE lower(website) LIKE 'http%' AND coalesce(website_phone, '') = '' "
                     "AND starts_with(website, 'http')"),
            ("cpages", "SELECT * FROM lead_pages WHERE company_id IN (SELECT id FROM cand)")]
_RESULTS += _site_phone_ctes("cpages")
_RESULTS += [("res", "SELECT c.id, coalesce(b2.website_phone, '') AS website_phone, "
                     "coalesce(b2.website_phone_type, '') AS website_phone_type, "
                     "coalesce(b2.website_phone2, '') AS website_phone2, "
                     "coalesce(b2.website_phone2_type, '') AS website_phone2_type FROM cand c "
                     "LEFT JOIN b2 ON b2.id = c.id")]


def _lead_results(spark: SparkSession, sf_dir: str):
    leads = fixture_leads(spark, sf_dir)
    pages = fixture(spark, sf_dir, "site_pages").withColumn(
        "company_id", F.col("company_id") + F.lit(1000000000))
    results = VF.verify_websites(VF.website_candidates(leads, "unverified"), pages)
    return leads, results


@register("apply_site_phones", O.with_fixtures(
    ["leads_raw", "site_pages"],
    "SELECT l.id, CASE WHEN r.website_phone <> '' THEN r.website_phone ELSE l.website_phone END AS website_phone, "
    "CASE WHEN r.website_phone <> '' THEN r.website_phone_type ELSE l.website_phone_type END AS website_phone_type, "
    "CASE WHEN r.website_phone <> '' THEN r.website_phone2 ELSE l.website_phone2 END AS website_phone2, "
    "CASE WHEN r.website_phone <> '' THEN r.website_phone2_type ELSE l.website_phone2_type END "
    "AS website_phone2_type FROM leads l LEFT JOIN res r ON r.id = l.id", _RESULTS))
def q_apply_site_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verify the unverified leads' websites from their captured pages and
    write the found phones back."""
    leads, results = _lead_results(spark, sf_dir)
    out = VF.apply_site_phones(leads, results, EDIT_AS_OF)
    return out.select("id", "website_phone", "website_phone_type", "website_phone2", "website_phone2_type")


@register("verify_metrics", O.with_fixtures(
    ["leads_raw", "site_pages"],
    "SELECT (SELECT count(*) FROM leads WHERE lower(website) LIKE 'http%') AS has_website, "
    "(SELECT count(*) FROM leads WHERE lower(website) LIKE 'http%' AND coalesce(website_phone, '') <> '') AS verified, "
    "(SELECT count(*) FROM leads WHERE lower(website) LIKE 'http%' AND coalesce(website_phone, '') = '') "
    "AS not_verified, (SELECT count(*) FROM res) AS checked, "
    "(SELECT count(*) FROM res WHERE website_phone <> '') AS found, "
    "(SELECT count(*) FROM res WHERE website_phone <> '') AS saved", _RESULTS))
def q_verify_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads, results = _lead_results(spark, sf_dir)
    return VF.verify_metrics(leads, results)


# Flow C on captured pages: newest home page, contact page by the home page's link.
_CAPTURED = [O.LEADS_VIEW,
             ("cand", "SELECT id FROM leads WHERE lower(website) LIKE 'http%' AND coalesce(website_phone, '') = '' "
                      "AND starts_with(website, 'http')"),
             ("cpages", "SELECT 1000000000 + company_id AS company_id, 1 AS page_ord, html, body_text FROM captured_site "
                        "WHERE kind = 'site_home' AND page_id % 4 = 1 UNION ALL "
                        "SELECT 1000000000 + page_id // 4, 2, html, body_text FROM captured_site WHERE kind = 'site_contact'"),
             *_site_phone_ctes("cpages"),
             ("res", "SELECT c.id, coalesce(b2.website_phone, '') AS website_phone, coalesce(b2.website_phone2, '') AS "
                     "website_phone2, coalesce(b2.all_phones, '') AS all_phones FROM cand c LEFT JOIN b2 ON b2.id = c.id")]


@register("verify_captured", O.with_fixtures(["leads_raw", "captured_site"], "SELECT * FROM res", _CAPTURED))
def q_verify_captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fixture(spark, sf_dir, "captured_site").withColumn("company_id", F.col("company_id") + F.lit(1000000000))
    results = VF.verify_captured(VF.website_candidates(fixture_leads(spark, sf_dir), "unverified"), pages)
    return results.select("id", "website_phone", "website_phone2", F.array_join("all_phones", ", ").alias("all_phones"))


# ---------------------------------------------------------------- session creation, newest-first scan (M5, S3)

from ..sources.leads import newest_first  # noqa: E402

RUN_SOURCES = ["google_maps", "jobstreet", "hiredly"]
RUN_INFO = "Queries: 3 | Concurrency: 3"


@register("create_session", O.with_fixtures(
    ["listings", "leads_raw", "sessions_raw"],
    "SELECT CAST(id AS BIGINT) AS id, sources, query_info, result_count FROM sessions_raw UNION ALL "
    "SELECT CAST((SELECT coalesce(max(id), 0) + 1 FROM sessions_raw) AS BIGINT), "
    f"{O.q(', '.join(RUN_SOURCES))}, {O.q(RUN_INFO)}, (SELECT count(*) FROM merged)", _MERGED))
def q_create_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions after a collection run over the fixture listings."""
    sessions = fixture(spark, sf_dir, "sessions_raw")
    merged = merge_listings(fixture(spark, sf_dir, "listings"))
    new = MU.session_for_run(merged, sessions, RUN_SOURCES, RUN_INFO, EDIT_AS_OF)
    return (sessions.select("id", "sources", "query_info", "result_count")
            .unionByName(new.select("id", "sources", "query_info", "result_count")))


@register("leads_newest_first", O.with_fixtures(
    ["leads_raw"], "SELECT id, name, sources FROM leads_raw ORDER BY id DESC"))
def q_leads_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_first(fixture_leads(spark, sf_dir)).select("id", "name", "sources")
