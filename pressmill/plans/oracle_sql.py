"""DuckDB twins of the derived tables and Column functions.

Used only to state the independent SQL check of each shipped query. DuckDB's
regex engine is RE2: ``regexp_replace`` needs the 'g' flag to replace every
match, and RE2's ``(?U)`` means "ungreedy", so ASCII ``\\s`` is used (the
test corpus carries only ASCII whitespace).
"""

from __future__ import annotations

from pressmill.functions.text import UNSAFE
from pressmill.plans.derive import CRAWL_EPOCH, PERIOD_BY_TOP_EVENT, PLACE_TYPES, SOURCE_LISTS, TRASH_RULES, TYPE_BY_FIRST_EVENT
from pressmill.schemas import CHANNELS, LOCATION_DELETE_CHARS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def collapse_ws(x: str) -> str:
    return f"regexp_replace({x}, '\\s+', ' ', 'g')"


def untag(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


def unescape_html(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                    ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def clean_html(x: str) -> str:
    for pattern in UNSAFE:
        x = f"regexp_replace({x}, {q(pattern)}, '', 'g')"
    return f"(CASE WHEN regexp_matches({x}, '<[A-Za-z]') THEN {x} ELSE '<p>' || {x} || '</p>' END)"


def title_of(html: str) -> str:
    t = f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1)"
    return strip(collapse_ws(unescape_html(untag(t))))


def main_html(html: str) -> str:
    art = f"nullif(regexp_extract({html}, '(?is)<article\\b[^>]*>(.*?)</article>', 1), '')"
    main = f"nullif(regexp_extract({html}, '(?is)<main\\b[^>]*>(.*?)</main>', 1), '')"
    body = f"regexp_extract({html}, '(?is)<body\\b[^>]*>(.*?)</body>', 1)"
    return f"coalesce({art}, {main}, {body})"


def rules_values() -> str:
    rows = ", ".join(f"({i}, {q(u)}, {q(t)}, {n})" for i, u, t, n in TRASH_RULES)
    return f"(VALUES {rows}) AS r(id, url, text, length)"


def trash_exists(url: str, body: str) -> str:
    return f"""EXISTS (SELECT 1 FROM {rules_values()}
        WHERE ({url} IS NULL OR coalesce(regexp_matches({url}, r.url), false))
          AND ({body} IS NULL OR {body} = ''
               OR (coalesce(regexp_matches({body}, r.text), false)
                   AND (r.length = 0 OR length({body}) <= r.length))))"""


def initial_status(is_trash: str, channel: str) -> str:
    keep = ", ".join(q(c) for c in ("industry", "research", "government", "other", "general"))
    return f"(CASE WHEN {is_trash} THEN 'trash' WHEN {channel} IN ({keep}) THEN 'keep' ELSE 'raw' END)"


PAGE_ARTICLES_CTE = f"""
page_raw AS (
    SELECT page_id, url AS article_url, {title_of('html')} AS title, {main_html('html')} AS raw_body
    FROM pages),
page_art AS (
    SELECT page_id, article_url, title, {collapse_ws(clean_html('raw_body'))} AS body
    FROM page_raw)
"""

ARTICLES_CTE = f"""
articles AS (
    SELECT d.doc_id AS id,
           'https://news.example.org/' || d.lang || '/' || substr(sha256(d.text), 1, 20) AS article_url,
           d.lang AS source_language,
           split_part(d.text, chr(10), 1) AS title,
           d.text AS body,
           TRY_CAST(nullif(regexp_extract(d.source, '(\\d+)$', 1), '') AS BIGINT) AS search_pk,
           TIMESTAMP '{CRAWL_EPOCH}' + to_hours(CAST(d.doc_id AS BIGINT)) AS post_date_crawled,
           d.lang = 'en' AS translated,
           l.quality IS NOT NULL AS processed,
           coalesce(l.toxic = 1, false) AS pushed,
           CAST(NULL AS VARCHAR) AS status,
           CAST(NULL AS VARCHAR) AS channel
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""

SEARCH_TYPE_SQL = "(CASE first_type " + " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in TYPE_BY_FIRST_EVENT) + " END)"
PERIOD_SQL = "(CASE top_type " + " ".join(f"WHEN '{e}' THEN '{p}'" for e, p in PERIOD_BY_TOP_EVENT) + " END)"
EMAIL_USERS_SQL = f"(SELECT user_id FROM events GROUP BY user_id HAVING arg_min(event_type, event_id) = 'error')"

SEARCHES_CTE = f"""
search_users AS (
    SELECT user_id,
           max(CASE WHEN event_type = 'view' THEN ts END) AS last_view,
           arg_min(event_type, event_id) AS first_type,
           arg_max(event_type, event_id) AS last_type,
           arg_max(event_type, (value, event_id)) AS top_type
    FROM events GROUP BY user_id),
searches AS (
    SELECT user_id AS id,
           'search-' || user_id AS search_id,
           {SEARCH_TYPE_SQL} AS search_type,
           CASE WHEN {SEARCH_TYPE_SQL} = 'article'
                THEN 'https://news.example.org/item/' || user_id END AS article_url,
           CASE WHEN {SEARCH_TYPE_SQL} = 'rss'
                THEN 'https://feeds.example.org/' || user_id || '.xml' END AS rss_link,
           'topic ' || first_type AS query,
           {sql_list(SOURCE_LISTS)}[(user_id % {len(SOURCE_LISTS)}) + 1] AS source,
           {sql_list(CHANNELS)}[(user_id % 7) + 1] AS channel,
           CAST(user_id % 13 AS BIGINT) AS search_depth,
           last_type <> 'error' AS active,
           {PERIOD_SQL} AS period,
           last_view AS last_processed,
           CASE WHEN user_id % 4 = 0 THEN '10.0.0.' || user_id END AS response_address,
           CASE WHEN contains({sql_list(SOURCE_LISTS)}[(user_id % {len(SOURCE_LISTS)}) + 1], 'google_cse')
                THEN first_type END AS exact_terms
    FROM search_users)
"""


def ts_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def parts_cte(name: str, source: str, key: str, text: str, extra: str = "") -> str:
    """CTE ``name(key, extra..., parts)``: translation parts of ``text`` (T5)."""
    x = f"{name}_"
    return f"""
{x}w AS (
    SELECT {key}{extra}, list_filter(string_split_regex({strip(text)}, '\\s+'), lambda x: x <> '') AS words
    FROM {source}),
{x}s AS (
    SELECT {key}{extra}, CASE WHEN len(words) = 0 THEN ['']
        ELSE string_split(regexp_replace(array_to_string(words, ' '), '\\. ', '.' || chr(1), 'g')
                          || CASE WHEN ends_with(array_to_string(words, ' '), '.') THEN chr(1) ELSE ' ' END,
                          chr(1)) END AS sents
    FROM {x}w),
{x}k AS (
    SELECT {key}{extra}, list_reduce(sents,
        lambda acc, x: CASE WHEN length(acc.cur) + length(x) + 1 < 1000
                            THEN {{'out': acc.out, 'cur': acc.cur || x || ' '}}
                            ELSE {{'out': list_append(acc.out, acc.cur), 'cur': x || ' '}} END,
        {{'out': []::VARCHAR[], 'cur': ''}}) AS st
    FROM {x}s),
{name} AS (SELECT {key}{extra}, list_append(st.out, st.cur) AS parts FROM {x}k)"""


def paragraphs_cte(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name(key, n_pieces, groups, markup)``."""
    x = f"{name}_"
    return f"""
{x}p AS (
    SELECT {key}, string_split(regexp_replace(regexp_replace(replace({untag(text)}, chr(10), ' '), '[“”]', '"', 'g'),
                                              '([.!?][\\t ")])', '\\1' || chr(1), 'g'), chr(1)) AS pieces
    FROM {source}),
{x}g AS (
    SELECT {key}, len(pieces) AS n_pieces,
           list_transform(range(0, CAST(ceil(len(pieces) / 10) AS BIGINT)),
                          lambda k: array_to_string(pieces[k * 10 + 1 : k * 10 + 10], '')) AS groups
    FROM {x}p),
{x}b AS (
    SELECT {key}, n_pieces, groups, list_reduce(groups,
        lambda acc, g: {{'out': list_append(acc.out,
                            CASE WHEN ((length(CASE WHEN acc.carry THEN '"' || g ELSE g END)
                                        - length(replace(CASE WHEN acc.carry THEN '"' || g ELSE g END, '"', ''))) % 2 = 1)
                                      AND NOT ends_with(CASE WHEN acc.carry THEN '"' || g ELSE g END, '"')
                                 THEN (CASE WHEN acc.carry THEN '"' || g ELSE g END) || '"'
                                 ELSE (CASE WHEN acc.carry THEN '"' || g ELSE g END) END),
                         'carry': ((length(CASE WHEN acc.carry THEN '"' || g ELSE g END)
                                    - length(replace(CASE WHEN acc.carry THEN '"' || g ELSE g END, '"', ''))) % 2 = 1)
                                  AND NOT ends_with(CASE WHEN acc.carry THEN '"' || g ELSE g END, '"')
                                  AND len(acc.out) < len(groups) - 1}},
        {{'out': []::VARCHAR[], 'carry': false}}) AS st
    FROM {x}g),
{name} AS (
    SELECT {key}, n_pieces, len(groups) AS n_groups,
           array_to_string(list_transform(st.out, lambda s: '<p> ' || s || '</p>'), chr(10)) AS markup
    FROM {x}b)"""


def grams_cte(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name(key, gram, cnt)``: character trigrams (A6). Each text is
    split into characters once; trigrams are built inside the list, so the
    text is never copied into the exploded rows."""
    return f"""
{name}_t AS (SELECT {key}, string_split(' ' || lower({collapse_ws(text)}) || ' ', '') AS c FROM {source}),
{name} AS (
    SELECT {key}, gram, count(*) AS cnt
    FROM (SELECT {key}, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram
          FROM {name}_t WHERE len(c) >= 3)
    GROUP BY ALL)"""


def lang_model_cte() -> str:
    """CTEs ``prof(lang, gram, delta)`` and ``prior(lang, unseen)`` from documents."""
    return f"""{grams_cte('train_g', 'documents', 'doc_id', 'text')},
per AS (SELECT d.lang, g.gram, sum(g.cnt) AS n FROM train_g g JOIN documents d USING (doc_id) GROUP BY ALL),
prof AS (SELECT lang, gram, ln(n + 1) AS delta FROM per),
prior AS (SELECT lang, -ln(sum(n) + (SELECT count(DISTINCT gram) FROM per)) AS unseen FROM per GROUP BY lang)"""


def detect_cte(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name(key, detected)`` (needs lang_model_cte)."""
    return f"""{grams_cte(name + '_g', source, key, text)},
{name}_n AS (SELECT {key}, sum(cnt) AS n_grams FROM {name}_g GROUP BY ALL),
{name}_h AS (SELECT g.{key}, p.lang, sum(g.cnt * p.delta) AS hit FROM {name}_g g JOIN prof p USING (gram) GROUP BY ALL),
{name}_s AS (
    SELECT h.{key}, h.lang, n.n_grams * pr.unseen + h.hit AS score,
           row_number() OVER (PARTITION BY h.{key} ORDER BY n.n_grams * pr.unseen + h.hit DESC, h.lang DESC) AS rk
    FROM {name}_h h JOIN {name}_n n USING ({key}) JOIN prior pr USING (lang)),
{name} AS (
    SELECT s.{key}, b.lang AS detected
    FROM (SELECT DISTINCT {key} FROM {source}) s LEFT JOIN {name}_s b ON b.{key} = s.{key} AND b.rk = 1)"""


def keywords_cte(name: str, source: str, key: str, text: str, k: int) -> str:
    return f"""
{name}_tf AS (
    SELECT {key}, term, count(*) AS tf
    FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '\\p{{L}}+')) AS term FROM {source})
    GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_sc AS (
    SELECT t.{key}, t.term, t.tf * ln((SELECT count(*) FROM {source}) / d.df) AS score
    FROM {name}_tf t JOIN {name}_df d USING (term)),
{name} AS (
    SELECT * FROM (
        SELECT {key}, term, score,
               row_number() OVER (PARTITION BY {key} ORDER BY round(score, 9) DESC, term) AS rank
        FROM {name}_sc) WHERE rank <= {k})"""


from pressmill.functions.urls import _ACCENTED as ACCENTED, _PLAIN as PLAIN  # noqa: E402


def slugify(x: str) -> str:
    s = f"translate(lower({x}), {q(ACCENTED)}, {q(PLAIN)})"
    s = f"replace(replace(replace({s}, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"
    s = f"regexp_replace({s}, '[^a-z0-9_\\s-]', '', 'g')"
    s = f"regexp_replace({s}, '[\\s_-]+', '-', 'g')"
    return f"regexp_replace({s}, '^-+|-+$', '', 'g')"


NAV_CTE = f"""
nav AS (
    SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host,
           regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) AS site,
           regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS raw_title,
           {unescape_html("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title_text,
           {untag("regexp_extract(html, '(?is)<article[^>]*>.*?<p>(.*?)</p>', 1)")} AS lead,
           regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1) AS hs,
           regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2) AS ts
    FROM pages),
links AS (
    SELECT page_id, url, host, raw_title, title_text, k,
           CASE WHEN starts_with(hs[k + 1], '/') THEN site || hs[k + 1] ELSE hs[k + 1] END AS link,
           ts[k + 1] AS text
    FROM (SELECT *, unnest(range(0, len(hs))) AS k FROM nav))"""


def locations_cte(name: str, source: str, key: str, text: str) -> str:
    """``name``(key, name, type): places of the derived gazetteer, by comparing every name with the words at every place
    where its first word stands; names within a longer one do not count there."""
    words = "array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), ' ')"
    item = "string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')"
    kinds = "['" + "', '".join(PLACE_TYPES) + "']"
    marks = LOCATION_DELETE_CHARS.replace("'", "''")
    return f"""{name}_gaz AS (
  SELECT DISTINCT string_split({words.format('phrase')}, ' ') AS p,
         translate(array_to_string(list_transform(string_split(phrase, ' '),
             lambda x: replace(upper(x[1]), 'ẞ', 'Ss') || lower(substr(x, 2))), ' '), '{marks}', '') AS name, type
  FROM (SELECT lower(n_name) AS phrase, 'country' AS type FROM nation
        UNION ALL SELECT lower(r_name), 'region' FROM region
        UNION ALL SELECT array_to_string({item}[1:2 + item_id % 3], ' '), {kinds}[item_id % 4 + 1] FROM benchmark
        UNION ALL SELECT array_to_string({item}[1:5 + item_id % 3], ' '), {kinds}[(item_id + 1) % 4 + 1] FROM benchmark)
  WHERE type <> 'continent' AND {words.format('phrase')} <> ''),
{name}_w AS (SELECT {key}, string_split({words.format(text)}, ' ') AS w FROM {source}),
{name}_at AS (SELECT {key}, w, i, w[i] AS first FROM {name}_w, unnest(range(1, len(w) + 1)) AS r(i)),
{name}_hits AS (
  SELECT DISTINCT a.{key}, a.i, a.i + len(g.p) AS stop, g.p, g.name, g.type
  FROM {name}_at a JOIN {name}_gaz g ON g.p[1] = a.first AND a.w[a.i:a.i + len(g.p) - 1] = g.p),
{name} AS (
  SELECT DISTINCT {key}, name, type FROM {name}_hits h
  WHERE NOT EXISTS (SELECT 1 FROM {name}_hits o WHERE o.{key} = h.{key} AND o.i <= h.i AND o.stop >= h.stop
                    AND o.stop - o.i > h.stop - h.i))"""


#: Twin of ``derive.rich_responses``: what the precedence rules have to find on each page that was fetched as HTML.
RICH_CTE = f"""
rich_raw AS (
    SELECT page_id, page_id % 6 AS form, DATE '2015-01-01' + CAST(page_id % 2000 AS INTEGER) AS day,
           CASE WHEN page_id % 13 = 2 THEN url || '#moved' ELSE url END AS article_url,
           CASE WHEN page_id % 11 = 3 THEN 404 WHEN page_id % 17 = 5 THEN 503 ELSE 200 END AS status,
           page_id % 19 <> 4 OR page_id % 5 IN (0, 2) AS is_html FROM pages),
rich AS (
    SELECT page_id, article_url, status, is_html,
           CASE form WHEN 0 THEN 'Meta Author ' || page_id WHEN 1 THEN 'Item Author ' || page_id WHEN 2 THEN 'Rel Author ' || page_id
                     WHEN 3 THEN 'Class Author ' || page_id WHEN 4 THEN 'LD Author ' || page_id ELSE '' END AS authors,
           strftime(CASE form WHEN 0 THEN day + INTERVAL 24 HOUR + INTERVAL 30 MINUTE WHEN 2 THEN day + INTERVAL 6 HOUR + INTERVAL 42 MINUTE
                              WHEN 4 THEN day + INTERVAL 17 HOUR + INTERVAL 6 MINUTE ELSE CAST(day AS TIMESTAMP) END,
                    '%Y-%m-%d %H:%M:%S') AS post_date_created,
           CASE form WHEN 0 THEN 'https://img.example.org/' || page_id || '.jpg' WHEN 1 THEN '/pic/' || page_id || '.PNG'
                     WHEN 3 THEN 'https://img.example.org/' || page_id || '.bin' ELSE '' END AS top_image_url
    FROM rich_raw)"""
