"""Input frames derived by Spark from the driver tables.

The driver tables hold no company listings, so test inputs are derived from
them with SQL. Each text runs unchanged in Spark (tables passed as DataFrame
parameters) and in DuckDB (tables as views), so the oracle can inline it as a
CTE. Placeholders are ``{table}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

LISTINGS_SQL = """
WITH base AS (
  SELECT 1 AS src_no, CAST(c_custkey AS BIGINT) AS k, 'google_maps' AS source FROM {customer}
  UNION ALL SELECT 2, CAST(s_suppkey AS BIGINT), 'jobstreet' FROM {supplier}
  UNION ALL SELECT 3, CAST(p_partkey AS BIGINT), 'hiredly'   FROM {part}),
n AS (SELECT *, CASE WHEN k % 10 = 9 THEN 'Megacorp' ELSE CAST((k * 7919) % 100003 AS STRING) END AS f,
  lpad(CAST((k * 31 + 17) % 10000000 AS STRING), 7, '0') AS d7 FROM base)
SELECT CAST(src_no AS BIGINT) * 1000000000 + k AS ord, source,
  CASE WHEN k % 223 = 5 THEN '' WHEN k % 211 = 7 THEN '!!!' WHEN k % 97 = 3 THEN 'Tesla Parts ' || f
       WHEN k % 6 = 0 THEN 'Firm ' || f || ' Sdn Bhd'  WHEN k % 6 = 1 THEN 'FIRM ' || f || ' SDN. BHD.'
       WHEN k % 6 = 2 THEN 'Firm ' || f || ', Plt'     WHEN k % 6 = 3 THEN 'Firm-' || f || ' (M) Bhd'
       WHEN k % 6 = 4 THEN '  Firm  ' || f || ' '      ELSE 'Firm ' || f || ' Sdn. Bhd' END AS name,
  CASE WHEN src_no <> 1 THEN '' WHEN k % 5 = 0 THEN '+6012' || d7 WHEN k % 5 = 1 THEN '03-1' || d7
       WHEN k % 5 = 2 THEN '' WHEN k % 5 = 3 THEN '01' || CAST(k % 10 AS STRING) || '-' || d7 ELSE '603' || '2' || d7 END AS phone,
  CASE WHEN k % 4 = 0 THEN 'http://firm' || f || '.example.com' WHEN k % 4 = 1 THEN 'www.firm' || f || '.example.com'
       WHEN k % 4 = 2 THEN '' ELSE 'HTTPS://FIRM' || f || '.example.com' END AS website,
  CASE WHEN k % 3 = 0 THEN '' ELSE 'No ' || CAST(k % 50 AS STRING) || ', Bangsar' END AS address,
  CASE WHEN k % 7 < 3 THEN '' WHEN k % 7 = 3 THEN 'restaurant' ELSE 'IT company' END AS category,
  CASE WHEN src_no = 2 THEN '11-50 employees' ELSE '' END AS company_size,
  CASE WHEN src_no = 1 AND k % 2 = 0 THEN '4.' || CAST(k % 10 AS STRING) ELSE '' END AS rating,
  CASE WHEN src_no = 1 THEN 'https://maps.example.com/' || CAST(k AS STRING) ELSE '' END AS google_maps_url,
  CASE WHEN src_no = 2 THEN 'https://js.example.com/' || CAST(k AS STRING) ELSE '' END AS jobstreet_url,
  CASE WHEN src_no = 3 THEN 'https://hi.example.com/' || CAST(k AS STRING) ELSE '' END AS hiredly_url
FROM n
"""

# Columns not listed take '' (session_id NULL where shown); phone_type is
# added by the phone classifier, timestamps by the caller.
LEADS_SQL = """
WITH l AS (SELECT * FROM {listings})
SELECT ord AS id, name, phone, website, address, category, company_size, rating, source AS sources,
  google_maps_url, jobstreet_url, hiredly_url,
  CASE WHEN ord % 6 = 0 THEN 'called' WHEN ord % 6 = 1 THEN 'interested, called' ELSE '' END AS tags,
  CASE WHEN ord % 11 = 0 THEN 'ask for invoice' ELSE '' END AS notes,
  CASE WHEN ord % 9 = 0 THEN CAST(NULL AS BIGINT) ELSE ord % 5 END AS session_id,
  CASE WHEN ord % 13 = 0 THEN '0121234567' ELSE '' END AS website_phone
FROM l
"""

SITE_PAGES_SQL = """
WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k, CAST((CAST(c_custkey AS BIGINT) * 7919) % 997 AS STRING) AS f,
  lpad(CAST((CAST(c_custkey AS BIGINT) * 31 + 17) % 10000000 AS STRING), 7, '0') AS d7 FROM {customer})
SELECT k AS company_id, 1 AS page_ord, 'site_home' AS kind, 'http://firm' || f || '.example.com' AS url,
  CASE WHEN k % 8 = 0 THEN '<p>Call <a href="tel:+6012' || d7 || '">us</a></p>'
       WHEN k % 16 = 1 THEN '<p>Fax <a href="tel:031' || d7 || '">here</a></p>'
       WHEN k % 32 = 9 THEN '<p><span>Tel <a href="tel:031' || d7 || '">here</a></span> <span>Fax 03-2' || d7 || '</span></p>'
       WHEN k % 32 = 25 THEN '<ul class="c"><li>Fax<li><b>Ring</b><br><a href="tel:031' || d7 || '">here</a></ul><div>Faks <b><a href="tel:032' || d7 || '">x</a></b></div>'
       WHEN k % 8 = 2 THEN '<p>Chat <a href="https://wa.me/6012' || d7 || '">now</a></p>'
       WHEN k % 8 = 3 THEN '<!-- <a href="tel:0399999999">old</a> --><script>var a = "<a href=tel:0388888888>x</a>";</script><p>Welcome</p>'
       WHEN k % 8 = 4 THEN '<p>Hello</p><a href="tel:+6012' || d7 || '"><div>Call</div></a>'
       WHEN k % 8 = 5 THEN '<p>Ring <a class=x href=' || chr(39) || 'tel:&#x2B;6012' || d7 || chr(39) || '>us</a></p>'
       WHEN k % 8 = 6 THEN '<p>Chat <a href=https://wa.me/6012' || d7 || '?a=1&amp;b=2>now</a></p>'
       ELSE '<table><tr><td>Tel 03-1' || d7 || '</td><td>8899 units</td></tr></table>' END
  || CASE WHEN k % 3 = 0 THEN '<p><a href="/contact-us">Contact Us</a></p>'
          WHEN k % 3 = 1 THEN '<p><a href=' || chr(39) || '/contact-us' || chr(39) || '>Contact&nbsp;Us</a></p>'
          ELSE '<p><a href=/contact-us>Contact<br>Us</a></p>' END
  || CASE WHEN k % 11 = 5 THEN '<!-- <a href="tel:0377777777">never closed' ELSE '' END AS html,
  CASE WHEN k % 7 = 0 THEN CAST(NULL AS STRING) WHEN k % 3 = 0 THEN 'Our office 03-1' || d7 || ' is open daily from nine to five'
       WHEN k % 3 = 1 THEN 'Tel: 03-1' || d7 || ' Fax: 03-2' || d7 ELSE 'Order 03-1' || d7 || ' widgets' END AS body_text
FROM c
UNION ALL
SELECT k, 2, 'site_contact', 'http://firm' || f || '.example.com/contact-us',
  CASE WHEN k % 5 = 0 THEN '<p>Call <a href="tel:031' || d7 || '">us</a></p>' ELSE '<p>Find us</p>' END,
  'Hubungi 012-' || d7 || ' or write' FROM c WHERE k % 2 = 0
"""

FIXTURES = {
    "listings": (LISTINGS_SQL, ["customer", "supplier", "part"]),
    "leads_raw": (LEADS_SQL, ["listings"]),
    "site_pages": (SITE_PAGES_SQL, ["customer"]),
}


def register(name: str, sql: str, inputs: list[str]) -> None:
    """Add a derived fixture (used by later modules)."""
    FIXTURES[name] = (sql, inputs)


def fixture(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """Build a derived fixture in Spark. Inputs that are themselves fixtures are
    built recursively unless passed in ``given``."""
    sql, inputs = FIXTURES[name]
    frames = {}
    for t in inputs:
        if t in given:
            frames[t] = given[t]
        elif t in FIXTURES:
            frames[t] = fixture(spark, sf_dir, t, **given)
        else:
            frames[t] = read_table(spark, sf_dir, t)
    return spark.sql(sql, **frames)


def fixture_cte(name: str, _seen: set | None = None) -> list[tuple[str, str]]:
    """(name, DuckDB text) pairs, dependencies first, for a WITH clause."""
    _seen = set() if _seen is None else _seen
    sql, inputs = FIXTURES[name]
    out: list[tuple[str, str]] = []
    for t in inputs:
        if t in FIXTURES and t not in _seen:
            out += fixture_cte(t, _seen)
    if name not in _seen:
        _seen.add(name)
        out.append((name, sql.format(**{t: t for t in inputs})))
    return out


# A lead file to import, derived from orders: new names, names already stored,
# in-file duplicates, empty and 'nan' names, names with an empty key, padded
# values, 'nan' cells and phones with a leading zero.
IMPORT_FILE_SQL = """
WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS c FROM {orders})
SELECT k AS ord,
  CASE WHEN k % 101 = 1 THEN '' WHEN k % 103 = 2 THEN 'nan' WHEN k % 107 = 3 THEN '!!!'
       WHEN k % 109 = 4 THEN '   ' WHEN k % 3 = 0 THEN 'Firm ' || CAST(c % 1500 AS STRING)
       WHEN k % 3 = 1 THEN ' Acme ' || CAST(c % 2000 AS STRING) || ' Sdn. Bhd. '
       ELSE 'Shop-' || CAST(k % 4000 AS STRING) END AS Company,
  CASE WHEN k % 4 = 0 THEN '0' || CAST(123000000 + k % 1000000 AS STRING)
       WHEN k % 4 = 1 THEN '+60 3-' || lpad(CAST(k % 10000000 AS STRING), 8, '0')
       WHEN k % 4 = 2 THEN '' ELSE 'nan' END AS Phone,
  CASE WHEN k % 2 = 0 THEN 'http://shop' || CAST(k % 4000 AS STRING) || '.example.com' ELSE '' END AS Website,
  CASE WHEN k % 3 = 0 THEN ' Jalan ' || CAST(k % 90 AS STRING) || ' ' ELSE '' END AS Address,
  CASE WHEN k % 5 = 0 THEN 'retail' WHEN k % 5 = 1 THEN 'nan' ELSE '' END AS Industry
FROM o
"""
register("import_file", IMPORT_FILE_SQL, ["orders"])


# Sessions behind the fixture leads (one per non-NULL session_id).
SESSIONS_SQL = """
SELECT CAST(session_id AS BIGINT) AS id, min(sources) AS sources,
  'Queries: ' || CAST(count(*) AS STRING) || ' | Concurrency: 3' AS query_info,
  CAST(count(*) AS BIGINT) AS result_count
FROM {leads_raw} WHERE session_id IS NOT NULL GROUP BY session_id
"""
register("sessions_raw", SESSIONS_SQL, ["leads_raw"])

# An edit batch derived from orders: many rows per id (the later wins), ids
# that do not exist, rows without an id, NULL values and a column outside the
# write whitelist.
EDITS_SQL = """
SELECT CAST(o_orderkey AS BIGINT) AS ord,
  CASE WHEN o_orderkey % 50 = 7 THEN CAST(NULL AS BIGINT)
       ELSE 1000000000 + CAST(o_custkey AS BIGINT) % 1700 END AS id,
  '01' || CAST(o_orderkey % 10 AS STRING) || '-' || lpad(CAST(o_orderkey % 10000000 AS STRING), 7, '0') AS phone,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS STRING) ELSE 'note ' || CAST(o_orderkey AS STRING) END AS notes,
  '0399999999' AS website_phone2
FROM {orders}
"""
register("edits", EDITS_SQL, ["orders"])


# Result pages of the three directories, one page per customer / part /
# supplier row: place links (absolute and relative, repeated across pages),
# directory links with skip-worthy texts, query links, non-ASCII names and
# links that become equal once made absolute.
RESULT_PAGES_SQL = """
WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_nationkey AS BIGINT) AS seed,
    CAST((CAST(c_custkey AS BIGINT) * 7919) % 997 AS STRING) AS f,
    CAST(((CAST(c_custkey AS BIGINT) + 1) * 7919) % 997 AS STRING) AS f2 FROM {customer}),
p AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) % 5 AS seed,
    CAST((CAST(p_partkey AS BIGINT) * 7919) % 997 AS STRING) AS f FROM {part}),
s AS (SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(s_nationkey AS BIGINT) AS seed,
    CAST((CAST(s_suppkey AS BIGINT) * 31) % 97 AS STRING) AS f FROM {supplier})
SELECT 1000000000 + k AS page_id, 'maps_results' AS kind, 'google_maps' AS source, seed AS seed_no, k AS page_no,
  '<div role="feed"><div><div><a href="https://www.google.com/maps/place/Firm+' || f || '/@' || CAST(k AS STRING)
  || '">Firm ' || f || '</a></div></div><div><div><a class="x" href="/maps/place/Firm+' || f2 || '/@' || CAST(k + 1 AS STRING)
  || '">Firm ' || f2 || '</a></div></div><a href="https://www.google.com/search?q=' || CAST(k AS STRING)
  || '">More</a></div>' AS html
FROM c
UNION ALL
SELECT 2000000000 + k, 'dir_results', 'jobstreet', seed, k,
  '<ul><li><a href="/companies/firm-' || f || '?ref=list">  Firm ' || f || ' Sdn Bhd </a></li>'
  || '<li><a href="/companies/firm-' || f || '-reviews">Write a Review</a></li>'
  || '<li><a href="/companies?page=' || CAST(k % 7 AS STRING) || '">Next</a></li>'
  || CASE WHEN k % 5 = 0 THEN '<li><a href="https://my.jobstreet.com/companies/caf-' || f || '">Caf' || chr(233) || ' ' || f || '</a></li>'
          WHEN k % 5 = 1 THEN '<li><a href="/companies/x-' || f || '">X</a></li>'
          WHEN k % 5 = 2 THEN '<li><a href="/companies/open-' || f || '">Open ' || f || '<li><a href="/jobs/' || f || '">Jobs</a></li>'
          ELSE '<li><a href="/jobs/' || f || '">Jobs</a></li>' END
  || '</ul>'
FROM p
UNION ALL
SELECT 3000000000 + k, 'dir_results', 'hiredly', seed, k,
  '<div><a href="/companies/co-' || f || '">Co ' || f || '</a><a href="https://my.hiredly.com/companies/co-' || f
  || '">Co</a><a href="/companies?industry=' || f || '">All</a><a href="/jobs">Jobs</a></div>'
FROM s
"""
register("result_pages", RESULT_PAGES_SQL, ["customer", "part", "supplier"])

# Map-place detail pages (one per customer): tel link, phone buttons with an
# aria-label or only text, authority link, address button, category button,
# rating block; some pages have no h1 (dropped).
PLACE_PAGES_SQL = """
WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k, CAST((CAST(c_custkey AS BIGINT) * 7919) % 997 AS STRING) AS f,
  lpad(CAST((CAST(c_custkey AS BIGINT) * 31 + 17) % 10000000 AS STRING), 7, '0') AS d7 FROM {customer})
SELECT k AS page_id, 'https://www.google.com/maps/place/Firm+' || f AS url,
  '<html><body>' || CASE WHEN k % 17 = 0 THEN '' ELSE '<h1 class="DUwDvf"> Firm ' || f || ' &amp; Co </h1>' END
  || CASE WHEN k % 4 = 0 THEN '<a href="tel:+60 12-' || d7 || '">Call</a>'
          WHEN k % 4 = 1 THEN '<button data-item-id="phone:tel:03' || d7 || '" aria-label="Phone: 03-' || d7 || ' "><div>x</div></button>'
          WHEN k % 4 = 2 THEN '<button data-item-id="phone:tel:x" aria-label=""><div>012 ' || d7 || '</div></button>'
          ELSE '<button data-item-id="oh" aria-label="Phone: 03-' || d7 || '">hours</button>' END
  || CASE WHEN k % 3 = 0 THEN '<a data-item-id="authority" href="http://firm' || f || '.example.com">site</a>' ELSE '' END
  || '<button data-item-id=address aria-label=' || chr(39) || 'Address: Lot 1 &amp; 2, No ' || CAST(k % 50 AS STRING)
  || ', Bangsar' || chr(39) || '>a</button>'
  || '<button jsaction="pane.rating.category">' || CASE WHEN k % 2 = 0 THEN ' Restaurant ' ELSE 'IT company' END || '</button>'
  || CASE WHEN k % 7 = 3 THEN '<div class="x"><span aria-hidden="true">9.9</span></div>' ELSE '' END
  || CASE WHEN k % 5 = 0 THEN '' ELSE '<div class="F7nice "><span><span aria-hidden="true">4.' || CAST(k % 10 AS STRING) || '</span></span></div>' END
  || '</body></html>' AS html
FROM c
"""
register("place_pages", PLACE_PAGES_SQL, ["customer"])

# Directory-A company pages (one per part): label lines followed by values,
# an empty value, a repeated label (the last wins), a too-long value and
# non-ASCII characters that the line cleaner drops.
DIR_A_PAGES_SQL = """
WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST((CAST(p_partkey AS BIGINT) * 7919) % 997 AS STRING) AS f,
  p_type AS t FROM {part})
SELECT k AS page_id,
  'Firm ' || f || chr(10) || 'Website' || chr(10)
  || CASE WHEN k % 4 = 0 THEN '' ELSE ' http://firm' || f || '.example.com ' END || chr(10)
  || 'Industry' || chr(10) || t || chr(10)
  || 'Company size' || chr(10) || CASE WHEN k % 3 = 0 THEN repeat('x', 120) ELSE '11-50 employees' END || chr(10)
  || 'Primary location' || chr(10) || 'Kuala Lumpur ' || chr(183) || ' ' || CAST(k % 9 AS STRING) || chr(10)
  || CASE WHEN k % 5 = 0 THEN 'Industry' || chr(10) || 'Retail ' || CAST(k % 4 AS STRING) || chr(10) ELSE '' END
  || 'Website' AS body_text
FROM p
"""
register("dir_a_pages", DIR_A_PAGES_SQL, ["part"])

# Directory-B profile pages (one per part): navigation lines, the name, a
# 'jobs' line, category, 'Our Address' with short and long lines, and links
# to blocked hosts before the company website.
DIR_B_PAGES_SQL = """
WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST((CAST(p_partkey AS BIGINT) * 7919) % 997 AS STRING) AS f,
  p_brand AS b FROM {part})
SELECT k AS page_id,
  'Companies' || chr(10) || 'Log In' || chr(10) || 'x' || chr(10) || 'Ab' || chr(10)
  || CASE WHEN k % 13 = 0 THEN '' ELSE 'Co ' || f || ' Sdn Bhd' || chr(10) END
  || CASE WHEN k % 2 = 0 THEN '12 jobs' || chr(10) ELSE '' END
  || b || ' ' || CAST(k % 3 AS STRING) || chr(10)
  || 'Co ' || f || ' Sdn Bhd' || chr(10)
  || CASE WHEN k % 3 = 0 THEN '' ELSE 'Our Address' || chr(10) || 'KL' || chr(10) || '  ' || chr(10)
     || 'Lot ' || CAST(k % 40 AS STRING) || ', Jalan Ampang, KL' || chr(10) END
  || 'English' AS body_text,
  '<div><a href="https://www.facebook.com/co' || f || '">fb</a><a href="/about">About</a>'
  || CASE WHEN k % 4 = 0 THEN '' ELSE '<a href="https://co' || f || '.example.com">Visit</a>' END
  || '<a href="https://my.hiredly.com/jobs">Jobs</a></div>' AS html
FROM p
"""
register("dir_b_pages", DIR_B_PAGES_SQL, ["part"])

# Captured pages of company websites (one company per customer): every home
# page captured twice (the newer one counts), the contact page under its own
# address, pages of no company, and pages of other kinds.
CAPTURED_SQL = """
WITH p AS (SELECT * FROM {site_pages})
SELECT 4 * company_id AS page_id, 'site_home' AS kind, '' AS source, CAST(0 AS BIGINT) AS seed_no,
  CAST(0 AS BIGINT) AS page_no, 'http://c' || CAST(company_id AS STRING) || '.example.com/' AS url, company_id,
  '<p>Old <a href="tel:0399999999">call</a></p>' AS html, 'Old 03-9999 9999' AS body_text FROM p WHERE page_ord = 1
UNION ALL
SELECT 4 * company_id + 1, kind, '', 0, 0, 'http://c' || CAST(company_id AS STRING) || '.example.com/', company_id,
  html, body_text FROM p WHERE page_ord = 1
UNION ALL
SELECT 4 * company_id + 2, kind, '', 0, 0, 'http://c' || CAST(company_id AS STRING) || '.example.com/contact-us',
  CAST(NULL AS BIGINT), html, body_text FROM p WHERE page_ord = 2
UNION ALL
SELECT 4 * company_id + 3, 'maps_place', 'google_maps', 0, 0, 'http://c' || CAST(company_id AS STRING) || '.example.com/contact-us',
  CAST(NULL AS BIGINT), '<p><a href="tel:0388888888">x</a></p>', '' FROM p WHERE page_ord = 1
"""
register("captured_site", CAPTURED_SQL, ["site_pages"])

# Blocklist settings, one per supplier: a JSON list with padded, blank and
# repeated entries.
SETTINGS_SQL = """
SELECT CAST(s_suppkey AS BIGINT) AS owner,
  CASE WHEN s_suppkey % 7 = 0 THEN '[]' WHEN s_suppkey % 11 = 0 THEN CAST(NULL AS STRING)
       ELSE '[" ' || s_name || ' ", "  ", "b.i.g.", "", "firm ' || CAST(s_suppkey AS STRING) || '"]' END AS value
FROM {supplier}
"""
register("blocklist_settings", SETTINGS_SQL, ["supplier"])
