"""Queries and oracle SQL of the hot-key operator."""

from __future__ import annotations

from sievewright.operators import hotkeys
from sievewright.session import table


def p3_found(spark, sf_dir):
    return hotkeys.heavy_keys(table(spark, sf_dir, "urls"))


def p3_key_stats(spark, sf_dir):
    return hotkeys.key_stats(table(spark, sf_dir, "urls"), table(spark, sf_dir, "page_html"))


def p3_key_profile(spark, sf_dir):
    return hotkeys.key_profile(table(spark, sf_dir, "urls"))


QUERIES = {"p3_found": p3_found, "p3_key_stats": p3_key_stats, "p3_key_profile": p3_key_profile}

_KEYS = """
WITH k AS (
  SELECT 'domain' AS key_field, nullif(regexp_replace(lower(trim(domain)), '\\.+$', ''), '') AS key_value, * FROM urls
  UNION ALL
  SELECT 'host' AS key_field, nullif(regexp_replace(lower(trim(host)), '\\.+$', ''), '') AS key_value, * FROM urls
)"""

ORACLE = {
    "p3_found": _KEYS + """
SELECT key_field, key_value FROM k WHERE key_value IS NOT NULL
GROUP BY key_field, key_value HAVING count(*) > 0.01 * (SELECT count(*) FROM urls)""",
    "p3_key_stats": _KEYS + """,
d AS (SELECT DISTINCT key_field, key_value, url_norm FROM k WHERE key_value IS NOT NULL),
p AS (SELECT url_norm, count(*) AS n, sum(coalesce(body_text_len, 0)) AS len FROM page_html GROUP BY url_norm),
a AS (SELECT key_field, key_value, count(*) AS n_rows, count(DISTINCT url_norm) AS n_urls FROM k WHERE key_value IS NOT NULL GROUP BY 1, 2),
b AS (SELECT key_field, key_value, sum(n) AS n_pages, sum(len) AS sum_len FROM d LEFT JOIN p USING (url_norm) GROUP BY 1, 2)
SELECT key_field, key_value, n_rows, n_urls, CAST(coalesce(n_pages, 0) AS BIGINT) AS n_pages, CAST(coalesce(sum_len, 0) AS BIGINT) AS sum_len
FROM a JOIN b USING (key_field, key_value)""",
    "p3_key_profile": _KEYS + """,
f AS (SELECT key_field, key_value, status, count(*) AS n FROM k WHERE key_value IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT key_field, key_value, status AS mode_status, n AS mode_rows FROM f
      QUALIFY row_number() OVER (PARTITION BY key_field, key_value ORDER BY n DESC, status) = 1),
a AS (SELECT key_field, key_value, count(*) AS n_rows, quantile_disc(attempts, 0.5) AS p50_attempts, quantile_disc(attempts, 0.9) AS p90_attempts
      FROM k WHERE key_value IS NOT NULL GROUP BY 1, 2)
SELECT key_field, key_value, n_rows, mode_status, mode_rows, p50_attempts, p90_attempts FROM a LEFT JOIN m USING (key_field, key_value)""",
}
