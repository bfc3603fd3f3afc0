"""SQL of the core queries, written for another engine and independent of the DataFrame code."""

from __future__ import annotations

from scholion.functions.similarity import STOPWORDS
from scholion.functions.sources import ARCHIVE_MARKS, MEDIA_CREDITS, MEDIA_KINDS
from scholion.functions.text import ABBREVIATIONS

_REFS = "SELECT DISTINCT ref_id, doc_id, ref_idx, author, year, title, doi, url, raw_ref, citation_key FROM parsed_refs"
_CITS = "SELECT DISTINCT cit_id, doc_id, paragraph_index, seq, text, claim_type, citation_key, citation_marker, marker_type, confidence, drop_reason FROM citations"
_WORKS = "SELECT work_id, source_name, title, year, doi, publisher FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY retrieved_at DESC, source_name DESC, title DESC, year DESC, doi DESC) AS rn FROM catalog_works) WHERE rn = 1"
_CHECKS = "SELECT DISTINCT check_id, ref_id, url, coalesce(lower(trim(category)), 'unknown') AS category, status_code, page_title, redirect_url, cited_title, checked_at FROM link_checks"
_WITH = f"WITH refs AS ({_REFS}), cits AS ({_CITS}), works AS ({_WORKS}), checks AS ({_CHECKS})"


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _doi(x: str) -> str:
    bare = rf"regexp_replace(lower(regexp_replace({x}, '^\s+|\s+$', '', 'g')), '^(https?://(dx\.)?doi\.org/|doi:\s*)', '')"
    bare = rf"regexp_replace(regexp_replace({bare}, '[.,;)\]>]+$', ''), '\s+', '', 'g')"
    return f"CASE WHEN {bare} LIKE '10.%' THEN {bare} ELSE '' END"


def _title(x: str) -> str:
    return _squeeze(f"translate(lower({x}), '\"''“”‘’-–—', '')")


def _markup(x: str) -> str:
    x = f"regexp_replace({x}, '<[^<>]*>', '', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return _squeeze(x)


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: length(t) >= 3))"


def _significant(x: str) -> str:
    stops = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z][a-z''-]+')), lambda t: t NOT IN ({stops}))"


_PARAS = r"SELECT doc_id, unnest(range(len(p))) AS para_idx, unnest(p) AS para FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL)"
_MARKED = rf"""regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(para, '(?i)\b({ABBREVIATIONS})\.(\s)', '\1' || chr(1) || '\2', 'g'), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '...', chr(2)),
  '(?i)(et al)\.(\s*\()', '\1' || chr(1) || '\2', 'g'), '([.!?]+["''\x{{201D}}\x{{2019}})]*)\s+', '\1' || chr(3), 'g')"""
_SENTENCES = rf"""SELECT doc_id, para_idx, unnest(range(len(s))) AS sent_idx, unnest(s) AS sentence FROM (
  SELECT doc_id, para_idx, list_filter(list_transform(string_split({_MARKED}, chr(3)), lambda x: regexp_replace(replace(replace(x, chr(1), '.'), chr(2), '...'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM ({_PARAS}))"""
_LINES = r"SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL)"
_FORMAT = r"CASE WHEN regexp_matches(coalesce(raw_ref, ''), '\x{201C}.+\x{201D}.*(vol\.|pp?\.)') THEN 'mla' ELSE 'apa' END"
_APA = r"^(.*?)\s*\((\d{4}[a-z]?|n\.d\.)\)\.\s*(.*?)(?:\.\s+\p{Lu}.*)?$"
_VIA = f"""keyed AS (SELECT ref_id, {_doi('doi')} AS k, sha256({_title('title')}) AS h FROM refs),
  d AS (SELECT {_doi('doi')} AS k, min(work_id) AS by_doi FROM works WHERE {_doi('doi')} <> '' GROUP BY 1),
  t AS (SELECT sha256({_title('title')}) AS h, min(work_id) AS by_title FROM works WHERE {_title('title')} <> '' GROUP BY 1),
  via AS (SELECT ref_id, coalesce(by_doi, by_title) AS work_id, CASE WHEN by_doi IS NOT NULL THEN 'doi' WHEN by_title IS NOT NULL THEN 'title' ELSE 'miss' END AS via FROM keyed LEFT JOIN d USING (k) LEFT JOIN t USING (h))"""
_PAIRS = f"pairs AS (SELECT r.*, w.work_id, w.title AS work_title, w.year AS work_year FROM refs r JOIN works w ON {_doi('r.doi')} = {_doi('w.doi')} AND {_doi('r.doi')} <> '')"
_SURNAMES = r"""sur AS (SELECT doc_id, ref_id, ref_idx, year, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(author, '\s*;\s*|\s*,?\s*&\s*|,?\s+and\s+'),
  lambda p: regexp_replace(lower(CASE WHEN contains(p, ',') THEN split_part(p, ',', 1) ELSE regexp_extract(trim(p), '(\S+)$', 1) END), '[^\p{L}''-]', '', 'g')), lambda n: length(n) > 1))) AS surname FROM refs)"""


def _overlap(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / nullif(len({a}), 0)"



# No look-around here: a letter that is used up by one match is seen again in a second pass.
_TIDY = r"regexp_replace(regexp_replace(regexp_replace(translate(text, chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(173) || chr(8288), ''), '\r\n?', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
_PASS = r"regexp_replace({0}, '([a-z])\s*\n\s*([a-z])', '\1 \2', 'g')"
_HYPHENLESS = rf"regexp_replace({_TIDY}, '-\n(\s*[a-z])', '\1', 'g')"
_CLEAN = rf"regexp_replace({_PASS.format(_PASS.format(_HYPHENLESS))}, '[ \t]{{2,}}', ' ', 'g')"
_MEDIA = rf"(regexp_matches(raw, '(?i)\[({MEDIA_KINDS})\]') OR regexp_matches(raw, '(?i)\b({MEDIA_CREDITS})\b'))"
_ARCHIVE = rf"regexp_matches(raw, '(?i)\b({ARCHIVE_MARKS})\b')"
_WORDS3 = "list_distinct(regexp_extract_all(lower({0}), '[a-z]{{3,}}'))"
_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY retrieved_at DESC, title DESC, year DESC, doi DESC, authors DESC) AS rn FROM catalog_works) WHERE rn = 1)"
_TITLED = f"titled AS (SELECT r.*, w.work_id, w.title AS work_title, w.year AS work_year, w.doi AS work_doi, w.authors FROM refs r JOIN latest w ON {_title('r.title')} = {_title('w.title')} AND {_title('r.title')} <> '')"

_CHECKED_IDS = r"""regexp_replace(coalesce(regexp_extract(raw, '(10\.\d{4,9}/[^\s"<>]+)', 1), ''), '[.,;)\]>]+$', '') AS doi, regexp_replace(coalesce(regexp_extract(raw, '(https?://[^\s"<>]+)', 1), ''), '[.,;)\]>]+$', '') AS any_url"""
_CHECKED = """SELECT ref_id, CASE WHEN ok THEN author ELSE '' END AS author, CASE WHEN NOT ok THEN '' WHEN year = '' THEN 'n.d.' ELSE year END AS year, CASE WHEN ok THEN title ELSE '' END AS title, doi,
        CASE WHEN doi <> '' THEN '' ELSE any_url END AS url, CASE WHEN ok THEN 'regex' ELSE 'fallback' END AS method, NOT ok AS needs_review FROM (SELECT *, author <> '' AND title <> '' AS ok FROM c)"""


SQL: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {_CLEAN} AS body FROM documents",
    "doi_normalize": f"{_WITH} SELECT ref_id, coalesce({_doi('doi')}, '') AS doi FROM refs",
    "title_hash_key": f"{_WITH} SELECT ref_id, sha256({_title('title')}) AS title_hash FROM refs",
    "cache_keys": f"{_WITH} SELECT ref_id, concat_ws('|', CASE WHEN coalesce({_doi('doi')}, '') <> '' THEN 'by-doi/' || {_doi('doi')} END, CASE WHEN coalesce(title, '') <> '' THEN 'by-title-hash/' || substr(sha256({_title('title')}), 1, 12) END) AS keys FROM refs",
    "citation_key": rf"""{_WITH} SELECT ref_id, CASE WHEN coalesce(n, '') <> '' AND coalesce(y, '') <> '' THEN n || y ELSE '' END AS made_key FROM
      (SELECT ref_id, regexp_replace(regexp_extract(trim(author), '^([^,\s]+)', 1), '[^\p{{L}}]', '', 'g') AS n, coalesce(nullif(regexp_extract(year, '(\d{{4}})', 1), ''), trim(year)) AS y FROM refs)""",
    "clean_year": rf"{_WITH} SELECT work_id, CASE WHEN regexp_matches(y, '^\d{{4}}$') THEN y WHEN regexp_extract(y, '((?:19|20)\d{{2}})', 1) <> '' THEN regexp_extract(y, '((?:19|20)\d{{2}})', 1) ELSE 'n.d.' END AS clean_year FROM (SELECT work_id, coalesce(year, '') AS y FROM works)",
    "claim_type_detect": rf"""{_WITH} SELECT cit_id, CASE WHEN regexp_matches(text, '["\x{{201C}}][^"\x{{201D}}]{{3,}}["\x{{201D}}]') THEN 'quotation' ELSE 'paraphrase' END AS detected FROM cits WHERE text IS NOT NULL""",
    "markup_strip": f"{_WITH} SELECT work_id, {_markup('title')} AS plain_title FROM works",
    "identifiers": rf"""{_WITH} SELECT ref_id, d AS found_doi, CASE WHEN d <> '' THEN '' ELSE regexp_replace(coalesce(regexp_extract(raw_ref, '(https?://[^\s"<>]+)', 1), ''), '[.,;)\]>]+$', '') END AS found_url FROM
      (SELECT ref_id, raw_ref, regexp_replace(coalesce(regexp_extract(raw_ref, '(10\.\d{{4,9}}/[^\s"<>]+)', 1), ''), '[.,;)\]>]+$', '') AS d FROM refs)""",
    "url_hosts": rf"""{_WITH} SELECT host, count(*) AS n, bool_or(regexp_matches(host, '^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2\d|3[01])\.)') OR regexp_matches(host, '(\.local|\.internal|^)$')) AS blocked
      FROM (SELECT lower(regexp_extract(url, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM checks WHERE url <> '') GROUP BY host""",
    "sentence_split": f"SELECT doc_id, CAST(para_idx AS INT) AS para_idx, CAST(sent_idx AS INT) AS sent_idx, sentence FROM ({_SENTENCES})",
    "paragraph_grid_counts": f"SELECT doc_id, CAST(para_idx AS INT) AS para_idx, count(*) AS n_sentences, CAST(sum(length(sentence)) AS BIGINT) AS n_chars FROM ({_SENTENCES}) GROUP BY ALL",
    "line_blocks_merge": rf"""WITH l AS ({_LINES}), m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(In|The|After|Between) ') OR lag(trim(line)) OVER o = '' OR lag(line) OVER o IS NULL THEN 1 ELSE 0 END) OVER o AS block
      FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS pl FROM l) WINDOW o AS (PARTITION BY doc_id ORDER BY line_no))
      SELECT doc_id, CAST(block AS BIGINT) AS block, {_squeeze("string_agg(line, ' ' ORDER BY line_no)")} AS body FROM m WHERE trim(line) <> '' GROUP BY doc_id, block""".replace(
        "lag(trim(line)) OVER o = '' OR lag(line) OVER o IS NULL", "trim(pl) = '' OR pl IS NULL"
    ),
    "section_scan": rf"""WITH l AS (SELECT *, CASE WHEN regexp_matches(line, '^(In|The|After|Between|By|On) ') THEN 1 ELSE 0 END AS starts FROM ({_LINES})),
      w AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS near, count(*) OVER (PARTITION BY doc_id) AS n FROM l)
      SELECT doc_id, CAST(min(line_no) AS INT) AS first_line FROM w WHERE starts = 1 AND near >= 2 AND line_no >= floor(n * 0.3) GROUP BY doc_id""",
    "reference_format_detect": f"{_WITH} SELECT {_FORMAT} AS format, count(*) AS n FROM refs GROUP BY 1",
    "apa_fields": rf"""{_WITH}, r AS (SELECT ref_id, trim(coalesce(raw_ref, '')) AS raw FROM refs WHERE {_FORMAT} = 'apa'),
      g AS (SELECT *, regexp_extract(raw, '(?is)^(.*?)(\((?:(?:19|20)\d{{2}}[a-z]?|n\.d\.)\))(.*)$', ['a', 'y', 'z']) AS m, regexp_extract(raw, '(?s)^(.*?)\b((?:19|20)\d{{2}})\b', ['a', 'y']) AS b FROM r),
      h AS (SELECT *, m.y <> '' AS marked, regexp_replace(m.z, '^[\s.)]+', '') AS rest FROM g),
      f AS (SELECT ref_id, raw, marked, regexp_replace(regexp_replace(trim(CASE WHEN marked THEN m.a ELSE b.a END), '[,.;:]+$', ''), '^\d+[.)]\s*', '') AS author,
        CASE WHEN marked THEN coalesce(nullif(regexp_extract(m.y, '(\d{{4}})', 1), ''), 'n.d.') ELSE b.y END AS year,
        trim(regexp_replace(CASE WHEN regexp_extract(rest, '(?s)^(.+?)\.\s+[A-Z]', 1) <> '' THEN regexp_extract(rest, '(?s)^(.+?)\.\s+[A-Z]', 1) ELSE regexp_replace(trim(regexp_replace(rest, '(?s)\s+(?:https?://|doi:).*$', '')), '\.+$', '') END, '(?s)\s*,\s*\d+\(.*$', '')) AS t FROM h),
      c AS (SELECT *, CASE WHEN marked THEN t ELSE '' END AS title, {_CHECKED_IDS} FROM f)
      {_CHECKED}""",
    "mla_fields": rf"""{_WITH}, r AS (SELECT ref_id, trim(coalesce(raw_ref, '')) AS raw, regexp_replace(trim(coalesce(raw_ref, '')), '^\d+[.)]\s*', '') AS bare FROM refs WHERE {_FORMAT} = 'mla'),
      a AS (SELECT *, trim(CASE WHEN regexp_extract(bare, '^(.{{2,200}}?)\.\s+[A-Z\x{{201C}}"]', 1) <> '' THEN regexp_extract(bare, '^(.{{2,200}}?)\.\s+[A-Z\x{{201C}}"]', 1) ELSE regexp_extract(bare, '(?s)^(.+?)\. ', 1) END) AS author,
        coalesce(list_extract(regexp_extract_all(raw, '\b((?:19|20)\d{{2}})\b', 1), -1), '') AS year, trim(regexp_extract(bare, '(?s)\x{{201C}}([^"]+?)\x{{201D}}', 1)) AS q, trim(regexp_extract(bare, '(?s)"([^"]+?)"', 1)) AS s FROM r),
      f AS (SELECT *, regexp_replace(substr(bare, length(author) + 1), '^[. ]+', '') AS rest FROM a),
      c AS (SELECT *, CASE WHEN q <> '' THEN q WHEN s <> '' THEN s WHEN author = '' THEN '' ELSE trim(CASE WHEN regexp_extract(rest, '(?s)^(.+?)\.\s+(?:[A-Z\d]|https?://)', 1) <> '' THEN regexp_extract(rest, '(?s)^(.+?)\.\s+(?:[A-Z\d]|https?://)', 1) ELSE split_part(rest, '.', 1) END) END AS title, {_CHECKED_IDS} FROM f)
      {_CHECKED}""",
    "labelled_fields": f"""{_WITH} SELECT ref_id, {', '.join(f"CASE WHEN lower(trim({c})) IN ('none', 'n/a', 'null') OR {c} IS NULL THEN '' ELSE trim({c}) END AS {c}" for c in ('author', 'year', 'title'))} FROM refs""",
    "cite_tag_parse": f"{_WITH} SELECT cit_id, citation_key AS key, length(text) AS body_chars FROM cits WHERE text IS NOT NULL AND citation_key IS NOT NULL",
    "chapter_ranges": r"""WITH r AS (SELECT DISTINCT book_id, pos, title, start_page, logical_pages FROM toc_entries WHERE toc_level = 1 AND start_page > 0 AND regexp_matches(title, '^\d{1,3}[.)]?\s'))
      SELECT book_id, pos, title, start_page AS page_start, greatest(start_page, coalesce(lead(start_page) OVER (PARTITION BY book_id ORDER BY pos, start_page, title) - 1, logical_pages)) AS page_end FROM r""",
    "inverted_index_rebuild": f"SELECT doc_id, array_to_string(w, ' ') AS rebuilt, len(list_distinct(w)) AS n_words FROM (SELECT doc_id, string_split({_squeeze('text')}, ' ') AS w FROM documents WHERE text IS NOT NULL)",
    "surname_index": f"{_WITH}, {_SURNAMES} SELECT doc_id, surname, count(*) AS n_refs, min(ref_idx) AS first_idx FROM sur GROUP BY doc_id, surname",
    "citation_links": rf"""{_WITH}, {_SURNAMES}, m AS (SELECT cit_id, doc_id, lower(regexp_extract(citation_marker, '([\p{{Lu}}][\p{{L}}''-]+)', 1)) AS surname, regexp_extract(citation_marker, '(\d{{4}})', 1) AS y FROM cits),
      j AS (SELECT cit_id, ref_id, ref_idx, y <> '' AND coalesce(contains(year, y), false) AS exact_year FROM m JOIN sur USING (doc_id, surname) WHERE surname <> '')
      SELECT cit_id, ref_id, exact_year FROM (SELECT *, row_number() OVER (PARTITION BY cit_id ORDER BY exact_year DESC, ref_idx, ref_id) AS rn FROM j) WHERE rn = 1""",
    "orphan_citations": f"{_WITH} SELECT cit_id, doc_id, citation_key FROM cits c WHERE citation_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.doc_id = c.doc_id AND r.citation_key = c.citation_key)",
    "phantom_references": f"{_WITH} SELECT ref_id, doc_id, citation_key FROM refs r WHERE NOT EXISTS (SELECT 1 FROM cits c WHERE r.doc_id = c.doc_id AND r.citation_key = c.citation_key)",
    "scope_references": f"{_WITH} SELECT ref_id, doc_id FROM refs r WHERE EXISTS (SELECT 1 FROM cits c WHERE r.doc_id = c.doc_id AND r.citation_key = c.citation_key AND c.claim_type = 'quotation')",
    "cache_lookup": f"{_WITH}, {_VIA} SELECT ref_id, work_id, via FROM via",
    "paragraph_densify": f"{_WITH}, g AS (SELECT doc_id, unnest(range(max(paragraph_index) + 1)) AS paragraph_index FROM cits WHERE paragraph_index >= 0 GROUP BY doc_id), n AS (SELECT doc_id, paragraph_index, count(*) AS n FROM cits GROUP BY ALL) SELECT doc_id, CAST(g.paragraph_index AS INT) AS paragraph_index, coalesce(n, 0) AS n_citations FROM g LEFT JOIN n USING (doc_id, paragraph_index)",
    "span_lookup": f"{_WITH}, p AS ({_PARAS}) SELECT cit_id, CASE WHEN para IS NULL THEN 'no_paragraph' WHEN contains(lower({_squeeze('para')}), lower({_squeeze('text')})) THEN 'exact' ELSE 'differs' END AS outcome FROM cits c LEFT JOIN p ON p.doc_id = c.doc_id AND p.para_idx = c.paragraph_index WHERE text <> ''",
    "locate_passage": f"""{_WITH}, p AS (SELECT doc_id, para_idx, {_tokens('para')} AS have FROM ({_PARAS})), w AS (SELECT cit_id, doc_id, {_tokens('text')} AS want FROM cits WHERE text <> ''),
      s AS (SELECT cit_id, para_idx, round(coalesce({_overlap('want', 'have')}, 0), 6) AS score FROM w JOIN p USING (doc_id))
      SELECT cit_id, CAST(para_idx AS INT) AS para_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY cit_id ORDER BY score DESC, para_idx) AS rn FROM s) WHERE rn = 1 AND score >= 0.4""",
    "repeated_citations": f"{_WITH}, t AS (SELECT cit_id, doc_id, {_tokens('text')} AS t FROM cits WHERE text <> '') SELECT DISTINCT x.doc_id, x.cit_id AS a, y.cit_id AS b FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.cit_id < y.cit_id WHERE len(x.t) > 0 AND len(y.t) > 0 AND len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) > 0.9",
    "page_title_match": f"{_WITH} SELECT check_id, CASE WHEN len({_tokens('cited_title')}) = 0 THEN true ELSE {_overlap(_tokens('cited_title'), _tokens(_markup('page_title')))} >= 0.5 END AS matches FROM checks WHERE page_title IS NOT NULL AND cited_title IS NOT NULL",
    "title_coverage": f"""{_WITH}, {_PAIRS}, s AS (SELECT ref_id, work_id, {_significant('title')} AS q, {_significant('work_title')} AS m FROM pairs), c AS (SELECT *, coalesce({_overlap('q', 'm')}, 1) AS c, len(q) AS n FROM s)
      SELECT ref_id, work_id, round(c, 6) AS coverage, c >= (CASE WHEN n <= 2 THEN 1 WHEN n <= 4 THEN (n - 1) / n ELSE greatest(0.6, (n - 2) / n) END) - 1e-9 AS relevant FROM c""",
    "identity_score": f"""{_WITH}, {_LATEST}, {_TITLED}, e AS (SELECT *, coalesce(doi, '') <> '' AS has_doi, coalesce(author, '') <> '' AND coalesce(len(authors), 0) > 0 AS has_author, coalesce(year, '') <> '' AND coalesce(work_year, '') <> '' AS has_year,
        coalesce({_overlap(_tokens('title'), _tokens('work_title'))}, 0) AS o, lower(trim(split_part(author, ',', 1))) AS surname FROM titled),
      p AS (SELECT *, (CASE WHEN o >= 0.6 THEN 2 WHEN o >= 0.3 THEN 1 ELSE 0 END) + CAST(has_author AND coalesce(surname <> '' AND len(list_filter(authors, lambda a: contains(lower(a), surname))) > 0, false) AS INT)
        + CAST(has_year AND coalesce(contains(work_year, year) OR contains(year, work_year), false) AS INT) AS pts, 3 * CAST(has_doi AS INT) + 2 + CAST(has_author AS INT) + CAST(has_year AS INT) AS most FROM e)
      SELECT ref_id, work_id, CASE WHEN has_doi AND coalesce(lower(doi) = lower(work_doi), false) THEN 'high' WHEN pts / most >= 0.7 THEN 'high' WHEN pts / most >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM p""",
    "dedup_exact": f"SELECT min(doc_id) AS kept_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY sha256(lower({_squeeze('text')}))",
    "page_number_pairs": "WITH p AS (SELECT DISTINCT book_id, start_page FROM toc_entries WHERE start_page > 0) SELECT book_id, bool_or(EXISTS (SELECT 1 FROM p q WHERE q.book_id = p.book_id AND q.start_page = p.start_page + 1)) AS has_pair FROM p GROUP BY book_id",
    "first_live_check": f"{_WITH} SELECT ref_id, check_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY priority, checked_at NULLS FIRST, check_id) AS rn FROM (SELECT *, CASE WHEN category IN ('content_match', 'ok') THEN 1 WHEN category = 'redirect' THEN 2 WHEN category = 'paywall' THEN 3 ELSE 9 END AS priority FROM checks)) WHERE rn = 1",
    "link_category_counts": f"{_WITH} SELECT category, count(*) AS n, count(DISTINCT ref_id) AS n_refs FROM checks GROUP BY category",
    "link_classify": f"""{_WITH} SELECT check_id, CASE WHEN coalesce(url, '') = '' THEN 'dead' WHEN status_code IN (401, 403, 451) THEN 'paywall' WHEN status_code IN (404, 410) THEN 'dead' WHEN status_code >= 500 THEN 'server_error' WHEN status_code BETWEEN 300 AND 399 THEN 'redirect'
      WHEN status_code = 200 AND cited_title IS NOT NULL AND coalesce({_markup('page_title')}, '') <> '' THEN CASE WHEN len(list_intersect({_WORDS3.format('cited_title')}, {_WORDS3.format(_markup('page_title'))})) >= 0.5 * len({_WORDS3.format('cited_title')}) AND len({_WORDS3.format('cited_title')}) > 0 THEN 'content_match' ELSE 'content_mismatch' END
      WHEN status_code BETWEEN 200 AND 299 THEN 'ok' ELSE 'unknown' END AS outcome FROM checks""",
    "source_type_route": f"{_WITH} SELECT ref_id, CASE WHEN {_ARCHIVE} THEN 'archive' WHEN {_MEDIA} THEN 'media' ELSE 'scholarly' END AS route FROM (SELECT ref_id, coalesce(raw_ref, '') AS raw FROM refs)",
    "publisher_route": f"{_WITH} SELECT CASE WHEN contains(p, 'university press') THEN 'press' WHEN contains(p, 'proceedings') THEN 'proceedings' WHEN regexp_matches(p, 'journal|annals|quarterly|review') THEN 'journal' WHEN p = '' THEN 'none' ELSE 'other' END AS kind, source_name, count(*) AS n FROM (SELECT source_name, lower(coalesce(publisher, '')) AS p FROM works) GROUP BY ALL",
    "text_quality_rule": "WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY classified_at DESC, verdict DESC, image_coverage DESC, text_fraction DESC) AS rn FROM text_quality) SELECT doc_id, CASE WHEN text_fraction < 0.5 THEN 'pure_scan' WHEN image_coverage >= 0.9 THEN 'scan_ocr' ELSE 'digital' END AS computed, coalesce(lower(trim(verdict)), 'none') AS given FROM l WHERE rn = 1 AND image_coverage IS NOT NULL AND text_fraction IS NOT NULL",
    "catalog_search": f"{_WITH} SELECT work_id, title, year FROM works WHERE contains(lower(title), 'chess') AND source_name = 'meridian'",
    "catalog_upsert": f"{_WITH} SELECT work_id, title, year, doi FROM works UNION ALL SELECT work_id, shelf_title, pub_year, doi FROM course_readings",
    "catalog_delete": f"{_WITH} SELECT source_name, count(*) AS n FROM works WHERE NOT (year IS NULL OR year = 'n.d.') GROUP BY source_name",
    "missing_identifiers": f"""{_WITH}, b AS (SELECT doc_id, CASE WHEN trim(coalesce(doi, '')) <> '' THEN 'doi' WHEN trim(coalesce(url, '')) <> '' OR regexp_matches(raw, '(?i)https?://|www\\.') THEN 'url' WHEN {_MEDIA} THEN 'media' WHEN {_ARCHIVE} THEN 'archive' ELSE 'none' END AS b
      FROM (SELECT *, coalesce(raw_ref, '') AS raw FROM refs)) SELECT doc_id, count(*) AS total, count(*) FILTER (b = 'doi') AS with_doi, count(*) FILTER (b = 'url') AS with_url, count(*) FILTER (b = 'media') AS missing_media, count(*) FILTER (b = 'archive') AS missing_archive, count(*) FILTER (b = 'none') AS should_have FROM b GROUP BY doc_id""",
    "ref_completeness": f"""{_WITH}, c AS (SELECT DISTINCT doc_id, citation_key, 1 AS cited FROM cits), l AS (SELECT DISTINCT ref_id, 1 AS live FROM checks WHERE category IN ('ok', 'content_match', 'redirect'))
      SELECT doc_id, count(*) AS n_refs, count(cited) AS n_cited, count(live) AS n_live, CAST(sum(CAST({_doi("coalesce(doi, '')")} <> '' AS INT)) AS BIGINT) AS n_doi FROM refs LEFT JOIN c USING (doc_id, citation_key) LEFT JOIN l USING (ref_id) GROUP BY doc_id""",
    "toc_cross_reference": "SELECT book_id, CASE WHEN max(start_page) IS NULL THEN 'none' WHEN max(start_page) > max(logical_pages) THEN 'incomplete' ELSE 'complete' END AS vote FROM toc_entries GROUP BY book_id",
    "completeness_verdict": """WITH a AS (SELECT book_id, CASE WHEN max(start_page) > max(logical_pages) THEN 'incomplete' ELSE 'complete' END AS vote FROM toc_entries GROUP BY book_id HAVING max(start_page) IS NOT NULL
      UNION ALL SELECT book_id, CASE WHEN bool_or(regexp_matches(lower(title), 'index|bibliography|references|works cited')) THEN 'complete' ELSE 'incomplete' END FROM toc_entries GROUP BY book_id
      UNION ALL SELECT book_id, CASE WHEN max(page_end) > max(logical_pages) THEN 'incomplete' ELSE 'complete' END FROM chapters GROUP BY book_id HAVING max(page_end) IS NOT NULL AND max(logical_pages) IS NOT NULL),
      v AS (SELECT book_id, count(*) FILTER (vote = 'incomplete') AS bad, count(*) FILTER (vote = 'complete') AS good FROM a GROUP BY book_id)
      SELECT book_id, CASE WHEN bad > 0 AND good > 0 THEN 'uncertain' WHEN bad > 0 THEN 'incomplete' ELSE 'complete' END AS verdict, CASE WHEN bad > 0 AND good > 0 THEN 'medium' WHEN greatest(bad, good) >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM v""",
    "paper_report_rollup": f"{_WITH}, c AS (SELECT coalesce(claim_type, 'none') AS c, coalesce(marker_type, 'none') AS m, drop_reason FROM cits) SELECT coalesce(c, 'all') AS claim_type, coalesce(m, 'all') AS marker_type, count(*) AS n, count(drop_reason) AS n_dropped FROM c GROUP BY ROLLUP (c, m)",
    "cache_stats": f"{_WITH}, {_VIA} SELECT count(*) AS lookups, count(*) FILTER (via <> 'miss') AS hits, count(*) FILTER (via = 'doi') AS by_doi FROM via",
    "paragraph_batches": f"""WITH s AS (SELECT doc_id, para_idx, length(para) // 4 AS tokens FROM ({_PARAS})), b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1500 AS batch FROM s)
      SELECT doc_id, CAST(batch AS BIGINT) AS batch, count(*) AS n_paragraphs, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM b GROUP BY doc_id, batch""",
    "vector_topk": """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS similarity FROM q, embeddings WHERE vec_id <> query_id)
      SELECT query_id, id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 10""",
    "apa_markers": r"""WITH m AS (SELECT 'parenthetical' AS kind, unnest(regexp_extract_all(text, '(\(\p{Lu}[\p{L}''-]+(?: (?:&|and) \p{Lu}[\p{L}''-]+| et al\.)?, \d{4}[a-z]?)', 1)) AS x FROM documents
      UNION ALL SELECT 'narrative', unnest(regexp_extract_all(text, '(\p{Lu}[\p{L}''-]+(?: (?:&|and) \p{Lu}[\p{L}''-]+| et al\.)? \(\d{4}[a-z]?\))', 1)) FROM documents)
      SELECT kind, regexp_extract(x, '^\(?(\p{Lu}[\p{L}''-]+)', 1) AS name, regexp_extract(x, '(\d{4})', 1) AS year, count(*) AS n FROM m GROUP BY ALL""",
    "mla_markers": r"""SELECT doc_id, len(m) AS n_marks, len(list_distinct(m)) AS n_names FROM (SELECT doc_id, regexp_extract_all(text, '\((\p{Lu}[\p{L}''-]+)(?: et al\.)? \d{1,4}(?:-\d{1,4})?\)', 1) AS m FROM documents WHERE text IS NOT NULL) WHERE len(m) > 0""",
    "secondary_markers": rf"""{_WITH}, m AS (SELECT cit_id, regexp_extract(text, '\((\p{{Lu}}[\p{{L}}''-]+)[^()]*?,? as cited in (\p{{Lu}}[\p{{L}}''-]+)', ['o', 'r']) AS g FROM cits WHERE text IS NOT NULL) SELECT cit_id, g.o AS original, g.r AS read_in FROM m WHERE g.o <> ''""",
    "quote_verify": rf"""{_WITH}, q AS (SELECT cit_id, doc_id, lower({_squeeze(r"regexp_extract(text, '[\x{201C}" + '"' + r"]([^\x{201C}\x{201D}" + '"' + r"]{3,})[\x{201D}" + '"' + r"]', 1)")}) AS q FROM cits WHERE claim_type = 'quotation' AND text IS NOT NULL), b AS (SELECT doc_id, lower({_squeeze('text')}) AS body FROM documents WHERE text IS NOT NULL)
      SELECT cit_id, CASE WHEN contains(body, q) THEN 'exact' WHEN length(q) > 20 AND contains(body, substr(q, 1, 50)) THEN 'near' ELSE 'missing' END AS outcome FROM q JOIN b USING (doc_id) WHERE q <> ''""",
    "uncited_sentences": f"""{_WITH}, s AS (SELECT doc_id, CAST(para_idx AS INT) AS paragraph_index, lower(sentence) AS s FROM ({_SENTENCES})), c AS (SELECT DISTINCT doc_id, paragraph_index, lower(text) AS c FROM cits WHERE text <> ''),
      j AS (SELECT s.doc_id, s.paragraph_index, s.s, (SELECT count(*) FROM c WHERE c.doc_id = s.doc_id AND c.paragraph_index = s.paragraph_index) AS near, (SELECT count(*) FROM c WHERE c.doc_id = s.doc_id AND c.paragraph_index = s.paragraph_index AND (contains(c.c, substr(s.s, 1, 30)) OR contains(s.s, substr(c.c, 1, 30)))) AS hit FROM s)
      SELECT doc_id, paragraph_index, count(*) AS n FROM j WHERE near > 0 AND hit = 0 GROUP BY ALL""",
    "paper_hints": f"{_WITH}, {_SURNAMES} SELECT doc_id, string_agg(DISTINCT surname, ' ' ORDER BY surname) AS surnames, count(DISTINCT ref_id) AS n_refs FROM sur GROUP BY doc_id",
    "paper_keywords": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL) SELECT doc_id, word, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 10",
    "reference_batches": f"{_WITH}, b AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY ref_idx, ref_id) - 1) // 10 AS batch FROM refs) SELECT doc_id, batch, count(*) AS n, min(ref_id) AS first_ref FROM b GROUP BY ALL",
    "html_title_extract": rf"{_WITH} SELECT check_id, nullif({_squeeze('page_title')}, '') AS title FROM checks WHERE page_title IS NOT NULL",
    "flag_coercion": f"{_WITH} SELECT check_id, category IN ('ok', 'true', 'yes', '1', 't', 'y') AS flag FROM checks",
    "event_properties": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "call_spacing": "SELECT event_type, count(*) FILTER (close) AS n_close, count(*) AS n FROM (SELECT *, coalesce(ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 60 SECOND, false) AS close FROM events) GROUP BY event_type",
    "job_latest_state": "SELECT user_id, event_type AS last_type, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "dead_letters": "SELECT user_id, n_errors, last_error FROM (SELECT user_id, count(*) AS n_errors, arg_max(event_id, (ts, event_id)) AS last_error FROM events WHERE event_type = 'error' GROUP BY user_id) WHERE n_errors > 3",
    "retry_backoff": "SELECT event_id, CAST(a AS INT) AS attempt, CAST(least(600, 60 * (1 << least(a - 1, 10))) AS INT) AS wait_s FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events WHERE event_type = 'error')",
    "events_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT s AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT unnest([b, b - INTERVAL 1 HOUR]) AS s, * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS b, * FROM events)) GROUP BY 1, 2",
    "events_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER o IS NULL OR ts > lag(ts) OVER o + INTERVAL 1800 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, session",
    "events_stream_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
