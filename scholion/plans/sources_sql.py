"""SQL of the queries in plans/sources.py, written for another engine and independent of the DataFrame code."""

from __future__ import annotations

from scholion.functions.sources import ARCHIVE_MARKS, MEDIA_CREDITS, MEDIA_KINDS, PDF_ADDRESSES
from scholion.operators.markers import NARRATIVE, PAGE, PAREN, SECOND_HAND, TELLING
from scholion.operators.reflist import STARTS
from scholion.plans.sql import _PARAS, _SENTENCES, _SURNAMES, _VIA, _WITH, _doi, _tokens

_q = lambda pattern: pattern.replace("'", "''")
_WORK = "w AS (SELECT *, CAST(nullif(regexp_extract(coalesce(year, ''), '(\\d{4})', 1), '') AS INT) AS y, list_filter(coalesce(authors, []), lambda a: coalesce(a, '') <> '') AS people FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY retrieved_at DESC, source_name DESC, title DESC, year DESC, doi DESC, publisher DESC, full_text_url DESC, authors DESC) AS rn FROM catalog_works) WHERE rn = 1)"


def _record(doi: str = "coalesce(doi, '')", abstract: str = "NULL", url: str = "full_text_url") -> str:
    return f"WITH {_WORK} SELECT work_id, {doi} AS doi, coalesce(title, '') AS title, coalesce(CAST(nullif(y, 0) AS VARCHAR), 'n.d.') AS year, array_to_string(people, '|') AS people, CAST({abstract} AS VARCHAR) AS abstract, {url} AS full_text_url FROM w"


def _found(kind: str, pattern: str, name_group: int, detail: int, original: int, where: str) -> str:
    p = _q(pattern)
    group = lambda n: f"regexp_extract(marker, '{p}', {n})" if n else "''"
    return f"SELECT doc_id, para_idx, sent_idx, sentence, marker, '{kind}' AS kind, lower(regexp_extract({group(name_group)}, '^([A-Z][A-Za-z''-]+)', 1)) AS surname, {group(detail)} AS detail, {group(original)} AS original FROM (SELECT *, unnest(list_distinct(regexp_extract_all(sentence, '{p}'))) AS marker FROM s WHERE {where})"


_FOUND = f"""{_WITH}, {_SURNAMES}, s AS (SELECT x.*, coalesce(lower(trim(citation_style)) = 'mla', false) AS mla FROM ({_SENTENCES}) x JOIN documents USING (doc_id)),
  m AS ({_found('secondary', SECOND_HAND, 2, 0, 1, 'true')} UNION ALL {_found('parenthetical', PAREN, 1, 2, 0, 'NOT mla')} UNION ALL {_found('narrative', NARRATIVE, 1, 2, 0, 'NOT mla')}
    UNION ALL {_found('parenthetical', PAGE, 1, 2, 0, 'mla')} UNION ALL {_found('narrative', TELLING, 1, 0, 0, 'mla')}),
  j AS (SELECT m.*, sur.ref_id, sur.ref_idx, detail <> '' AND coalesce(contains(sur.year, detail), false) AS exact FROM m JOIN sur USING (doc_id, surname)),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, para_idx, sent_idx, kind, marker ORDER BY exact DESC, ref_idx, ref_id) AS rn FROM j)
  SELECT f.doc_id, CAST(para_idx AS INT) AS para_idx, CAST(sent_idx AS INT) AS sent_idx, marker, kind, original, f.ref_id, refs.citation_key,
    CASE WHEN regexp_matches(sentence, '["\\x{{201C}}][^"\\x{{201D}}]{{3,}}["\\x{{201D}}]') THEN 'quotation' ELSE 'paraphrase' END AS claim_type FROM f JOIN refs USING (ref_id) WHERE rn = 1"""

_PASSAGE = f"""{_WITH}, sents AS ({_SENTENCES}), p AS (SELECT doc_id, para_idx, {_tokens('para')} AS have FROM ({_PARAS})), own AS (SELECT cit_id, text, {_tokens('text')} AS want FROM cits WHERE text <> ''),
  best AS (SELECT * FROM (SELECT c.cit_id, c.doc_id, p.para_idx, o.want, round(coalesce(len(list_intersect(want, have)) / nullif(len(want), 0), 0), 6) AS score, row_number() OVER (PARTITION BY c.cit_id ORDER BY round(coalesce(len(list_intersect(want, have)) / nullif(len(want), 0), 0), 6) DESC, p.para_idx) AS rn
    FROM cits c JOIN own o USING (cit_id) JOIN p ON p.doc_id = c.doc_id) WHERE rn = 1 AND score >= 0.4),
  mine AS (SELECT CAST(doc_id AS BIGINT) AS cit_id, count(*) AS n FROM ({_SENTENCES.replace(_PARAS, "SELECT cit_id AS doc_id, 0 AS para_idx, text AS para FROM cits WHERE text <> ''")}) GROUP BY 1),
  runs AS (SELECT b.cit_id, b.para_idx, b.score AS para_score, b.want, a.sent_idx AS i, z.sent_idx - a.sent_idx + 1 AS n FROM best b JOIN sents a ON a.doc_id = b.doc_id AND a.para_idx = b.para_idx JOIN sents z ON z.doc_id = b.doc_id AND z.para_idx = b.para_idx AND z.sent_idx >= a.sent_idx
    LEFT JOIN mine ON mine.cit_id = b.cit_id WHERE z.sent_idx - a.sent_idx + 1 <= greatest(coalesce(mine.n, 0), 1) + 1),
  scored AS (SELECT r.cit_id, r.para_idx, r.para_score, r.i, r.n, round(len(list_intersect(any_value(r.want), flatten(list({_tokens('x.sentence')})))) / len(any_value(r.want)), 6) AS s
    FROM runs r JOIN best b ON b.cit_id = r.cit_id JOIN sents x ON x.doc_id = b.doc_id AND x.para_idx = b.para_idx AND x.sent_idx BETWEEN r.i AND r.i + r.n - 1 GROUP BY ALL),
  f AS (SELECT *, row_number() OVER (PARTITION BY cit_id ORDER BY s DESC, n, i) AS rn FROM scored)
  SELECT cit_id, CAST(para_idx AS INT) AS para_idx, CAST(CASE WHEN s >= 0.4 THEN i + 1 ELSE 0 END AS INT) AS first_sentence, CAST(CASE WHEN s >= 0.4 THEN n ELSE 0 END AS INT) AS n_sentences, CASE WHEN s >= 0.4 THEN s ELSE para_score END AS score FROM f WHERE rn = 1"""

_REATTRIBUTED = rf"""{_WITH}, {_SURNAMES}, lost AS (SELECT cit_id, doc_id, list_distinct(regexp_split_to_array(lower(text), '[^\p{{L}}''-]+')) AS words FROM cits c WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.doc_id = c.doc_id AND r.citation_key = c.citation_key)),
  i AS (SELECT DISTINCT sur.doc_id, surname, citation_key FROM sur JOIN refs USING (ref_id)), h AS (SELECT cit_id, citation_key FROM lost JOIN i ON i.doc_id = lost.doc_id AND list_contains(words, surname))
  SELECT cit_id, min(citation_key) AS new_key FROM h GROUP BY cit_id HAVING count(*) = 1 AND min(citation_key) <> ''"""

_MLA_START = STARTS["mla"].partition("(?!")[0]
_STARTS_MLA = rf"regexp_matches(line, '{_q(_MLA_START)}') AND NOT regexp_matches(line, '{_q(_MLA_START)}(?:\(\d{{4}}[a-z]?\)|\(n\.d\.\))')"
_OPENS_MLA = _STARTS_MLA.replace("line", "body")
_GOES_ON = r"(?i)^(?:\[online\]|retrieved\s|journal,\s*\d+\s*\(\d+\))"
_QUOTED = r"^(?:\d+[.)]\s+)?[\x{201C}\x{22}]"


def _entries(style: str) -> str:
    starts = f"regexp_matches(line, '{_q(STARTS['apa'])}')" if style == "apa" else f"({_STARTS_MLA})"
    opened = f"{starts} AND NOT regexp_matches(line, '{_GOES_ON}')" + (f" OR regexp_matches(line, '{_QUOTED}')" if style == "mla" else "")
    open_end = r"regexp_matches(body, '^\p{Ll}') AND NOT regexp_matches(before, '[.?!)''\x{22}]$')" if style == "apa" else rf"NOT ({_OPENS_MLA}) AND NOT regexp_matches(body, '{_QUOTED}') AND NOT regexp_matches(before, '(?:\.|>|https?://\S+|pp?\.\s*\d+)$')"
    return rf"""SELECT '{style}' AS style, doc_id, CAST(entry AS INT) AS entry, string_agg(body, ' ' ORDER BY block) AS body FROM (
      SELECT *, sum(CASE WHEN before <> '' AND (regexp_matches(body, '{_GOES_ON}') OR regexp_matches(body, '^<?https?://') OR regexp_matches(body, '^[\w/-]+/>\.?$') OR {open_end}) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block) AS entry FROM (
        SELECT *, coalesce(lag(body) OVER (PARTITION BY doc_id ORDER BY block), '') AS before FROM (
          SELECT doc_id, block, regexp_replace(trim(regexp_replace(string_agg(line, ' ' ORDER BY line_no), '\s+', ' ', 'g')), '^\d+[.)]\s*', '') AS body FROM (
            SELECT *, sum(CASE WHEN prev = '' OR {opened} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM (
              SELECT *, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), '') AS prev FROM {style}_lines)) WHERE line <> '' GROUP BY doc_id, block) WHERE body <> '')) GROUP BY doc_id, entry"""


# The heading that was put there is the first line of its kind: the bodies have none.
_LISTS = rf"""{_WITH}, lists AS (SELECT doc_id, string_agg(regexp_replace(regexp_replace(raw_ref, '\s+', ' ', 'g'), '^(.{{60}}\S*) ', '\1' || chr(10)), chr(10) ORDER BY ref_idx, ref_id) AS list FROM refs WHERE raw_ref <> '' AND doc_id IS NOT NULL GROUP BY doc_id),
  papers AS (SELECT doc_id, CASE WHEN coalesce(lower(trim(citation_style)) = 'mla', false) THEN 'mla' ELSE 'apa' END AS style, list FROM documents JOIN lists USING (doc_id)),
  lines AS (SELECT doc_id, style, unnest(range(len(l))) AS line_no, trim(unnest(l)) AS line FROM (SELECT doc_id, style, string_split(list, chr(10)) AS l FROM papers)),
  apa_lines AS (SELECT * FROM lines WHERE style = 'apa'), mla_lines AS (SELECT * FROM lines WHERE style = 'mla')"""

_ADDRESS = " ".join(f"WHEN regexp_matches(p, '{marks}') THEN '{before}' || trim(doi) || '{after}'" for marks, before, after in PDF_ADDRESSES)
_RAW_MEDIA = rf"(regexp_matches(raw, '(?i)\[({MEDIA_KINDS})\]') OR regexp_matches(raw, '(?i)\b({MEDIA_CREDITS})\b'))"
_RAW_ARCHIVE = rf"regexp_matches(raw, '(?i)\b({ARCHIVE_MARKS})\b')"
_CHECK = "c AS (SELECT DISTINCT ON (check_id) check_id, ref_id, url, lower(trim(category)) AS category, status_code FROM link_checks)"
_DETAILS = {
    "ok": "the page loads", "content_match": "the page loads under the cited title", "content_mismatch": "the page loads under another title", "dead": "there is no such page", "redirect": "the page has moved",
    "paywall": "the page asks for a login", "server_error": "the server failed", "timeout": "no answer in time", "dns_error": "there is no such host", "wrong_type": "no page but a file",
}

SQL: dict[str, str] = {
    "found_citations": _FOUND,
    "cited_passage": _PASSAGE,
    "reattributed_keys": _REATTRIBUTED,
    "reference_entries": f"{_LISTS} {_entries('apa')} UNION ALL {_entries('mla')}",
    "publisher_pdf": f"WITH {_WORK} SELECT work_id, CASE {_ADDRESS} END AS address FROM (SELECT work_id, doi, lower(coalesce(publisher, '')) AS p FROM w WHERE doi <> '')",
    "guessed_identifiers": rf"""{_WITH}, g AS (SELECT ref_id, raw_ref, coalesce(regexp_extract(raw_ref, '(?i)(10\.\d{{4,}}/\S+)', 1), '') AS d FROM refs) SELECT ref_id, {_doi('d')} AS guessed_doi, trim(coalesce(regexp_extract(raw_ref, '\(\d{{4}}\)\.\s*([^.]+(?:\.[^.]+)?)', 1), '')) AS guessed_title FROM g""",
    "link_details": f"WITH {_CHECK} SELECT CASE category {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _DETAILS.items())} ELSE 'unknown outcome' END AS detail, count(*) AS n FROM c GROUP BY 1",
    "fetch_verdicts": rf"WITH {_CHECK} SELECT CASE WHEN NOT regexp_matches(url, '(?i)^https?://') THEN 'scheme' WHEN regexp_extract(url, '^[A-Za-z]+://(?:[^/@?#]*@)?([^/:?#]+)', 1) = '' THEN 'no_host' WHEN category = 'dns_error' THEN 'unresolved' WHEN status_code = 403 THEN 'private_answer' ELSE 'ok' END AS verdict, count(*) AS n FROM c WHERE url <> '' GROUP BY 1",
    "crossref_records": _record(abstract="'On ' || trim(regexp_replace(coalesce(publisher, ''), '\\s+', ' ', 'g'))", url="CAST(NULL AS VARCHAR)").replace("'On ' || trim(regexp_replace(coalesce(publisher, ''), '\\s+', ' ', 'g'))", "trim('On ' || regexp_replace(coalesce(publisher, ''), '\\s+', ' ', 'g'))"),
    "openalex_records": _record(doi="trim(coalesce(doi, ''))", url="nullif(full_text_url, '')"),
    "semantic_records": _record(),
    "core_records": _record(),
    "gutenberg_records": _record(doi="''"),
    "open_access": f"WITH {_WORK} SELECT work_id, full_text_url IS NOT NULL AS open FROM w",
    "resolved_sources": f"""{_WITH}, {_WORK}, {_VIA}, {_CHECK}, about AS (SELECT ref_id, raw, CASE WHEN {_RAW_ARCHIVE} THEN 'archive' WHEN {_RAW_MEDIA} THEN 'media' ELSE 'scholarly' END AS route FROM (SELECT ref_id, coalesce(raw_ref, '') AS raw FROM refs)),
      a AS (SELECT DISTINCT ref_id, 2 AS stage, 'own address' AS source, 0 AS rank, true AS has_text FROM link_checks WHERE lower(trim(category)) IN ('ok', 'content_match', 'redirect')
        UNION ALL SELECT v.ref_id, 3, w.source_name, CASE w.source_name WHEN 'openstacks' THEN 1 WHEN 'meridian' THEN 2 WHEN 'quillnet' THEN 3 ELSE 0 END, coalesce(w.full_text_url, '') <> '' FROM via v JOIN w ON w.work_id = v.work_id),
      b AS (SELECT *, row_number() OVER (PARTITION BY a.ref_id ORDER BY NOT has_text, stage, rank, source) AS rn FROM a JOIN about USING (ref_id) WHERE route <> 'archive' AND NOT (stage = 3 AND route = 'media'))
      SELECT about.ref_id, CASE WHEN about.route = 'archive' THEN 'archive' WHEN b.ref_id IS NULL THEN 'none' WHEN b.has_text THEN 'full_text' ELSE 'abstract' END AS outcome, coalesce(b.source, '') AS source FROM about LEFT JOIN b ON b.ref_id = about.ref_id AND b.rn = 1""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
