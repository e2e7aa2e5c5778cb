"""Independent SQL for the registry's queries, in DuckDB's dialect."""

from __future__ import annotations


_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_D2 = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: (CAST({0}[i] AS DOUBLE) - CAST({1}[i] AS DOUBLE)) * (CAST({0}[i] AS DOUBLE) - CAST({1}[i] AS DOUBLE))))"
_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _d2(a: str, b: str) -> str:
    return _D2.format(a, b)


def _cos(a: str, b: str) -> str:
    return f"({_DOT.format(a, b)} / (sqrt({_DOT.format(a, a)}) * sqrt({_DOT.format(b, b)})))"


#: Hits of the retrieval queries: five (or {k}) nearest of the indexed vectors for ids divisible by 100.
_HITS = """
ix AS (SELECT vec_id AS id, embedding, CAST(label AS VARCHAR) AS label, text AS content, source AS title, lang AS heading, source AS domain FROM embeddings JOIN documents ON vec_id = doc_id),
qs AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
pairs AS (SELECT query_id, ix.*, D2 AS distance FROM qs, ix),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs),
hits AS (SELECT *, greatest(0.0, least(1.0, 1 - distance / 2)) AS score FROM ranked WHERE rank <= {k})
""".replace("D2", _d2("embedding", "q"))


def _with_hits(rest: str, k: int = 5) -> str:
    return "WITH " + _HITS.format(k=k) + rest


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> ''))"
_CHUNKS = f"""c AS (SELECT doc_id, {_strip("text")} AS content FROM documents WHERE text IS NOT NULL), k AS (SELECT * FROM c WHERE length(content) >= 200)"""

_STATE = """
st AS (SELECT url, CASE WHEN page_id % 3 = 1 THEN sha256(html) ELSE 'stale' END AS content_hash, TIMESTAMP '2024-06-30 00:00:00' - to_days(CAST(page_id % 10 AS INTEGER)) AS last_crawled, 'old.md' AS output_file FROM pages WHERE page_id % 3 <> 0),
pg AS (SELECT page_id, url, sha256(html) AS content_hash FROM pages),
df AS (SELECT pg.*, CASE WHEN st.url IS NULL THEN 'new' WHEN TIMESTAMP '2024-06-30 00:00:00' - last_crawled > to_days(7) THEN 'stale' WHEN pg.content_hash <> st.content_hash THEN 'changed' ELSE 'unchanged' END AS reason FROM pg LEFT JOIN st ON pg.url = st.url)
"""
_KEYS = """
ex AS (SELECT doc_id AS id, 'document' AS kind, md5(text) AS digest FROM documents),
inc AS (SELECT conv_id AS id, 'turn' AS kind, CASE WHEN count(*) > count(text) THEN NULL ELSE min(md5(text)) END AS digest FROM conversations GROUP BY conv_id)
"""

#: The prompt, written out: three parts of fixed text around the excerpts and the question.
_PROMPTS = """
x AS (SELECT query_id, count(*) AS n, string_agg(E'\\n---\\nSource: ' || title || E'\\nSection: ' || heading || E'\\n\\n' || content || E'\\n', '' ORDER BY rank) AS excerpts FROM hits GROUP BY query_id),
prompts AS (SELECT qs.query_id, n, excerpts, 'What is in document ' || qs.query_id || '?' AS question,
  'You are an expert assistant helping developers use design system components and guidelines.' AS system,
  E'Use the following documentation excerpts to answer my question. Each excerpt includes metadata about the source.\\n\\nContext:\\n' || coalesce(excerpts, '') || E'\\n\\nQuestion: What is in document ' || qs.query_id
  || E'?\\n\\nInstructions:\\n- Provide a clear, accurate answer based on the documentation above\\n- If referencing specific components or patterns, mention them by name\\n'
  || E'- Include code examples from the documentation when relevant\\n- If the documentation doesn\\'t contain enough information, say so (i.e. say "I don\\'t know" as opposed to inferring)\\n'
  || '- Cite sources by mentioning the component or page name' AS prompt FROM qs LEFT JOIN x ON qs.query_id = x.query_id)"""
#: The article of a page as the documented markdown subset: the synthetic pages have headings, paragraphs, line ends and bold.
_ARTICLE = r"""
m0 AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '\s+', ' ', 'g') AS a FROM pages),
m1 AS (SELECT page_id, replace(replace(replace(replace(replace(replace(a, '<h1>', E'\n\n# '), '</h1>', E'\n\n'), '<p>', E'\n\n'), '</p>', E'\n\n'), '<br>', E'\n'), '<b>', '') AS a FROM m0),
m2 AS (SELECT page_id, replace(replace(replace(replace(a, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS a FROM m1),
m3 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(a, '\n +', E'\n', 'g'), '[ \t]+\n', E'\n', 'g'), '\n{3,}', E'\n\n', 'g') AS a FROM m2),
md AS (SELECT page_id, regexp_replace(regexp_replace(a, '^\s+', ''), '\s+$', '') AS markdown FROM m3)"""


def _unescaped(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


#: How many lines of comment stand above a document's sample sources.
_LINES = "lines AS (SELECT doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS above FROM documents)"

#: The files of the tree that documents are written as, without those that no reading has.
_TREE = """k AS (SELECT *, CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.js' WHEN 'fr' THEN '.tsx' WHEN 'es' THEN '.java' ELSE '.go' END AS extension,
            CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'javascript' WHEN 'fr' THEN 'typescript' WHEN 'es' THEN 'java' ELSE 'go' END AS language FROM documents),
        f AS (SELECT 'src/' || coalesce(lang, 'und') || '/d' || doc_id || extension AS source_id, 'd' || doc_id || extension AS title, language, extension, text AS body, CAST(strlen(text) AS BIGINT) AS size FROM k WHERE text <> ''
              UNION ALL SELECT 'src/o' || doc_id || '.c', 'o' || doc_id || '.c', 'c', '.c', '// café ' || doc_id || chr(10), CAST(length('// café ' || doc_id) + 1 AS BIGINT) FROM documents WHERE doc_id % 7 = 0)"""

ORACLE: dict[str, str] = {
    "prompt_build": _with_hits(f"""
        , {_PROMPTS} SELECT query_id, system, prompt FROM prompts"""),
    "answer_extractive": _with_hits(f"""
        , {_PROMPTS},
        b AS (SELECT *, {_strip("coalesce(excerpts, '')")} AS body FROM prompts),
        t AS (SELECT *, CASE WHEN body = '' THEN 'I don''t know' ELSE substr(substr(body, 1, 8192), strpos(substr(body, 1, 8192), chr(10) || chr(10)) + 2, 400) END AS answer FROM b)
        SELECT query_id, coalesce(n, 0) AS documents_retrieved, length(question) AS query_length, length(answer) AS answer_length, coalesce(n, 0) > 0 AS has_context, answer, CAST(NULL AS VARCHAR) AS error,
          length(system || prompt) // 4 + length(answer) // 4 AS total_tokens FROM t"""),
    "md_sections": f"""
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS section_no, role || ' ' || turn AS heading, CAST(2 AS BIGINT) AS level, {_strip("coalesce(text, '')")} AS content FROM conversations""",
    "md_chunks": f"""
        WITH t AS (SELECT conv_id, turn, role || ' ' || turn AS heading, {_strip("coalesce(text, '')")} AS body FROM conversations),
        p AS (SELECT *, length('## ' || heading) AS head, '## ' || heading || chr(10) || chr(10) || chr(10) || body AS content FROM t WHERE body <> ''),
        s AS (SELECT *, length('## ' || heading || chr(10)) + length(body) > 400 AS over FROM p),
        x AS (SELECT conv_id, turn, 0 AS part, '## ' || heading AS content, heading, 0 AS start_index, head AS end_index FROM s WHERE over AND head >= 10
              UNION ALL SELECT conv_id, turn, 1, content, heading, CASE WHEN over THEN head ELSE 0 END, CASE WHEN over THEN head ELSE 0 END + length(content) FROM s WHERE length(content) >= 10)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) - 1 AS chunk_no, content, 'text' AS chunk_type, heading, CAST(start_index AS BIGINT) AS start_index, CAST(end_index AS BIGINT) AS end_index, 'unknown_' || start_index AS chunk_id FROM x""",
    "md_blocks": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
        b AS (SELECT conv_id, turn, 0 AS o, 'text' AS type, 'Q ' || turn AS content, 0 AS start_pos FROM t
              UNION ALL SELECT conv_id, turn, 1, 'code', {_strip("text")}, length('Q ' || turn || ' ') FROM t WHERE {_strip("text")} <> ''
              UNION ALL SELECT conv_id, turn, 2, 'text', 'end', length('Q ' || turn || ' ') + 13 + length(text) FROM t)
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) - 1 AS block_no, type, content, CAST(start_pos AS BIGINT) AS start_pos FROM b""",
    "chunk_fallback": f"WITH {_CHUNKS} SELECT doc_id, CAST(0 AS BIGINT) AS chunk_no, 'text' AS chunk_type, CAST(NULL AS VARCHAR) AS heading, length(content) AS size, sha256(content) AS content_hash FROM k",
    "chunk_ids": f"WITH {_CHUNKS} SELECT doc_id, 'doc' || doc_id || '_0' AS chunk_id, length(content) <= 1500 AS valid FROM k",
    "chunk_estimate": "SELECT doc_id, greatest(1, length(text) // 850) AS chunks FROM documents",
    "chunk_samples": f"WITH {_CHUNKS} SELECT doc_id, 'TEXT' AS type, length(content) AS size, 'None' AS heading, replace(substr(content, 1, 150), chr(10), ' ') || '...' AS preview FROM k ORDER BY doc_id LIMIT 3",
    "chunk_stats": f"WITH {_CHUNKS} SELECT count(*) AS total_chunks, count(*) AS text_chunks, CAST(0 AS BIGINT) AS code_chunks, CAST(floor(sum(length(content)) / count(*)) AS BIGINT) AS avg_chunk_size, min(length(content)) AS min_chunk_size, max(length(content)) AS max_chunk_size FROM k",
    "doc_stats": "SELECT count(*) AS total_documents, count(*) FILTER (lang = 'en') AS markdown_documents, count(*) FILTER (lang <> 'en') AS tsx_documents, CAST(sum(length(text)) AS BIGINT) AS total_characters, CAST(floor(sum(length(text)) / count(*)) AS BIGINT) AS average_length FROM documents",
    "merge_small": """
        WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE text IS NOT NULL),
        r AS (SELECT conv_id, i, turn, role, text, 0 AS no, text AS acc, role AS heading FROM t WHERE i = 1
              UNION ALL SELECT t.conv_id, t.i, t.turn, t.role, t.text, CASE WHEN length(r.acc) + length(t.text) <= 600 THEN r.no ELSE r.no + 1 END,
                CASE WHEN length(r.acc) + length(t.text) <= 600 THEN r.acc || chr(10) || chr(10) || t.text ELSE t.text END, CASE WHEN length(r.acc) + length(t.text) <= 600 THEN r.heading ELSE t.role END
              FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
        SELECT conv_id, CAST(no AS BIGINT) AS no, arg_max(acc, i) AS content, arg_max(heading, i) AS heading, max_by(turn, i) AS end_index FROM r GROUP BY conv_id, no""",
    "code_lines_chunks": """
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE trim(text, E' \\t\\r\\n') <> ''),
        n AS (SELECT *, greatest(10, CAST(floor(500.0 / nullif(CAST(length(text) AS DOUBLE) / len(ls), 0)) AS BIGINT)) AS n FROM d),
        p AS (SELECT doc_id, n, len(ls) AS total, unnest(range(0, len(ls), n)) AS s, ls FROM n),
        c AS (SELECT doc_id, s, least(s + n, total) AS e, array_to_string(ls[s + 1 : s + n], chr(10)) AS content FROM p)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_no, s AS start_index, e AS end_index, sha256(content) AS content_hash FROM c WHERE trim(content, E' \\t\\r\\n') <> ''""",
    "md_pack_multi": f"""
        WITH RECURSIVE t AS (SELECT conv_id, turn, role = 'assistant' AS code, text FROM conversations WHERE text IS NOT NULL),
        g AS (SELECT *, sum(CASE WHEN code THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM t),
        b0 AS (SELECT conv_id, turn AS o, true AS code, {_strip("text")} AS content FROM g WHERE code
               UNION ALL SELECT conv_id, min(turn), false, {_strip("string_agg(text, chr(10) ORDER BY turn)")} FROM g WHERE NOT code GROUP BY conv_id, run),
        b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS i, CASE WHEN code THEN '```' || chr(10) || content || chr(10) || '```' ELSE content END AS piece FROM b0 WHERE content <> ''),
        r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST(7 AS BIGINT) AS n, '# Talk' || chr(10) AS txt, false AS code, CAST(0 AS BIGINT) AS start, CAST(NULL AS VARCHAR) AS out, false AS out_code, CAST(0 AS BIGINT) AS out_start FROM b
              UNION ALL SELECT b.conv_id, b.i, CASE WHEN r.n + length(b.content) > 300 THEN 7 ELSE r.n END + length(b.piece),
                CASE WHEN r.n + length(b.content) > 300 THEN '# Talk' || chr(10) ELSE r.txt END || chr(10) || chr(10) || b.piece, (r.code AND r.n + length(b.content) <= 300) OR b.code,
                CASE WHEN r.n + length(b.content) > 300 THEN r.start + length({_strip("r.txt")}) ELSE r.start END,
                CASE WHEN r.n + length(b.content) > 300 THEN {_strip("r.txt")} END, r.code, r.start FROM r JOIN b ON b.conv_id = r.conv_id AND b.i = r.i + 1),
        z AS (SELECT conv_id, i, out AS txt, out_code AS code, out_start AS start FROM r WHERE out IS NOT NULL
              UNION ALL SELECT conv_id, i + 1, {_strip("txt")}, code, start FROM r WHERE (conv_id, i) IN (SELECT conv_id, max(i) FROM r GROUP BY conv_id))
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS chunk_no, CASE WHEN code THEN 'code' ELSE 'text' END AS chunk_type, length(txt) AS size, start AS start_index, start + length(txt) AS end_index FROM z WHERE length(txt) >= 40""",
    "code_fence_chunks": f"""
        WITH b AS (SELECT doc_id, text, {_strip("text")} AS s FROM documents WHERE text IS NOT NULL),
        w AS (SELECT *, 'Intro here' || chr(10) || chr(10) || '```python' || chr(10) || s || chr(10) || '```' AS whole, string_split(s, chr(10)) AS ls FROM b),
        n AS (SELECT *, greatest(10, coalesce(CAST(floor(1500.0 / nullif(CAST(length(s) AS DOUBLE) / len(ls), 0)) AS BIGINT), 10)) AS n FROM w),
        p AS (SELECT doc_id, ls, n, unnest(range(0, len(ls), n)) AS pos FROM n WHERE length(whole) > 1500),
        c AS (SELECT doc_id, 0 AS pos, whole AS content, CAST(11 AS BIGINT) AS start_index, 11 + 10 + length(text) + 4 AS end_index FROM n WHERE length(whole) <= 1500
              UNION ALL SELECT doc_id, pos, '```python' || chr(10) || array_to_string(ls[pos + 1 : pos + n], chr(10)) || chr(10) || '```', 11 + pos, 11 + least(pos + n, len(ls)) FROM p
              UNION ALL SELECT doc_id, 1000000000, '```unknown' || chr(10) || 'last = 1' || chr(10) || '```', 25 + length(text) + 9, 25 + length(text) + 9 + 16 FROM b)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_no, content, start_index, end_index FROM c""",
    "code_script_chunks": """
        WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, 'javascript' AS language, CAST(0 AS BIGINT) AS chunk_no, CAST(0 AS BIGINT) AS start_index, CAST(1 AS BIGINT) AS end_index FROM d
        UNION ALL SELECT doc_id, 'javascript', 1, 1, n + 4 FROM d
        UNION ALL SELECT doc_id, 'javascript', 2, n + 4, n + 6 FROM d
        UNION ALL SELECT doc_id, 'javascript', 3, n + 6, n + 8 FROM d""",
    "markdown_files": f"SELECT md5('doc/' || doc_id) || '.md' AS file, 'Document: ' || doc_id AS title, lang, sha256({_strip('text')}) AS content_hash FROM documents WHERE text IS NOT NULL",
    "chunk_records": f"""
        WITH d AS (SELECT doc_id, lang, source, {_strip("text")} AS s FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, doc_id || '.md_0' AS chunk_id, 'mixed' AS type, 'chunk_type=code;domain=' || lang || ';heading=' || source || ';source=' || doc_id || '.md' AS metadata,
          length('## ' || source || chr(10)) + 2 + length('```' || chr(10) || 'x = 1' || chr(10) || '```') + CASE WHEN s = '' THEN 0 ELSE 2 + length(s) END AS size FROM d""",
    "tree_documents": f"""
        WITH {_TREE}
        SELECT source_id, title, language, 'codebase' AS source_type, 'markdown' AS format, extension, size,
          sha256('# ' || title || E'\\n\\n**File:** `' || source_id || E'`\\n**Language:** ' || language || E'\\n\\n```' || language || E'\\n' || body || E'\\n```\\n') AS content_hash FROM f""",
    "tree_lookup": f"""
        WITH {_TREE}
        SELECT 'fetch' AS way, 'src/en/d' || min(doc_id) || '.py' AS source_id FROM documents WHERE lang = 'en' AND text <> ''
        UNION ALL (SELECT 'ids', source_id FROM f WHERE language IN ('javascript', 'typescript') ORDER BY source_id LIMIT 10)
        UNION ALL SELECT 'component', 'category=Implementation;component=d' || doc_id || ';domain=components;file_type=tsx;framework=React;title=d' || doc_id FROM documents WHERE lang = 'fr'""",
    "tree_batch": f"WITH {_TREE} SELECT source_id, language, extension, size, sha256(body) AS content_hash, CAST(NULL AS VARCHAR) AS error FROM f",
    "tree_stream": f"WITH {_TREE} SELECT source_id, language, extension, size, sha256(body) AS content_hash, CAST(NULL AS VARCHAR) AS error FROM f",
    "filter_typed": "SELECT doc_id, n_chars FROM documents WHERE (n_chars >= 9 AND n_chars < 400 AND lang IN ('de', 'en')) OR (n_chars / 8.0 > 500.5 AND n_chars > 1000 AND coalesce(lang <> 'en', true))",
    "code_docstrings": """
        SELECT replace(path, '.', '_' || doc_id || '.') AS path, name, replace(doc, '@', CAST(doc_id AS VARCHAR)) AS doc FROM documents, (VALUES ('src/store.py', 'total', 'Sum of two.'), ('src/store.py', 'Store', 'Keeps rows.'), ('src/greet.js', 'greet', E'/**\\n* Says hello.\\n*/'), ('src/broken.py', NULL, 'ParseError'),
          ('snippet.python', 'python', 'Top @.'), ('snippet.python', 'python', NULL), ('snippet.javascript', 'javascript', E'/**\\n* Up @.\\n*/'), ('snippet.javascript', 'javascript', NULL)) AS t(path, name, doc)""",
    "links_by_source": r"""
        SELECT page_id, 'mobile' AS source FROM pages WHERE regexp_matches(url, '^http.*://m\.')
        UNION ALL SELECT page_id, 'plain' FROM pages WHERE NOT contains(url, '?') AND NOT contains(url, '#')""",
    "embed_errors": f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR text IS NULL OR {_strip('text')} = '' THEN 'text is blank' END AS error FROM documents",
    "retrieve_errors": _with_hits("""
        SELECT query_id, id, CAST(NULL AS VARCHAR) AS error FROM hits WHERE query_id % 300 = 200
        UNION ALL SELECT query_id, -1, CASE WHEN query_id % 300 = 0 THEN 'query has 3 dimensions, the index 64' ELSE 'query has no vector' END FROM qs WHERE query_id % 300 <> 200""", 2),
    "page_custom": f"""
        SELECT page_id, trim({_unescaped("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) AS heading, trim({_unescaped("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")}) AS ad, CAST(NULL AS VARCHAR) AS "none" FROM pages""",
    "crawl_reports": f"""
        WITH RECURSIVE {_ARTICLE.strip()},
        tall AS (SELECT page_id, length(markdown) >= 100 AS ok FROM md),
        e AS (SELECT page_id AS a, 2 * page_id + k AS b FROM pages, (VALUES (1), (2)) AS v(k)),
        x AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS d UNION SELECT b, d + 1 FROM x JOIN e ON a = id WHERE d < 3),
        y AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS d UNION SELECT b, d + 1 FROM y JOIN e ON a = id WHERE d < 2 AND b % 10 <> 4),
        dp AS (SELECT DISTINCT page_id, ok FROM x JOIN tall ON id = page_id),
        ag AS (SELECT DISTINCT page_id, ok FROM y JOIN tall ON id = page_id),
        st AS (SELECT page_id FROM dp WHERE ok UNION SELECT page_id FROM ag WHERE ok),
        r AS (SELECT 'deep' AS source, (SELECT count(*) FROM dp) AS pages, (SELECT count(*) FROM dp WHERE ok) AS stored, CAST(NULL AS VARCHAR) AS error
              UNION ALL SELECT 'broken', 0, 0, 'ConnectionError: unreachable'
              UNION ALL SELECT 'again', (SELECT count(*) FROM ag), (SELECT count(*) FROM ag WHERE ok AND page_id NOT IN (SELECT page_id FROM dp WHERE ok)), NULL)
        SELECT *, (SELECT count(*) FROM st) AS state FROM r""",
    "page_links": r"""
        WITH l AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
        f AS (SELECT DISTINCT page_id, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href ELSE href END AS link FROM l)
        SELECT * FROM f WHERE NOT regexp_matches(link, '\.pdf$')""",
    "html_markdown": f"WITH {_ARTICLE} SELECT page_id, markdown FROM md",
    "page_min_content": f"WITH {_ARTICLE} SELECT page_id, length(markdown) AS size FROM md WHERE length(markdown) >= 100",
    "entity_documents": "WITH " + _LINES + """, e AS (SELECT replace(s.path, '.', '_' || doc_id || '.') AS path, s.* EXCLUDE (path, a, b), a + above AS a, b + above AS b FROM lines, (VALUES
          ('src/store.py', 'total', 'function', 'def total(a, b) -> int', 'Sum of two.', ['a', 'b'], 'int', NULL, E'def total(a, b: int) -> int:\\n    \"\"\"Sum of two.\"\"\"\\n    return a + b', 'python', NULL, 5, 7),
          ('src/store.py', 'Store', 'class', 'class Store(Base)', 'Keeps rows.', NULL, NULL, 'dataclass', E'class Store(Base):\\n    \"\"\"Keeps rows.\"\"\"\\n\\n    def put(self, key, value):\\n        return {key: value}\\n\\n    async def later(self):\\n        pass', 'python', 'put', 11, 18),
          ('src/store.py', 'put', 'function', 'def put(self, key, value)', NULL, ['self', 'key', 'value'], NULL, NULL, E'    def put(self, key, value):\\n        return {key: value}', 'python', NULL, 14, 15),
          ('src/greet.js', 'greet', 'function', 'export async function greet(name, times = 2)', E'/**\\n* Says hello.\\n*/', ['name', 'times'], NULL, NULL, E'export async function greet(name, times = 2) {\\n  const text = "}" + name;\\n  return text;\\n}', 'javascript', NULL, 7, 10),
          ('src/greet.js', 'Counter', 'class', 'class Counter extends Base', NULL, NULL, NULL, NULL, E'class Counter extends Base {\\n  add(x) {\\n    return x;\\n  }\\n}', 'javascript', NULL, 12, 16),
          ('src/greet.js', 'twice', 'function', 'const twice = (x, y) =>', NULL, ['x', 'y'], NULL, NULL, 'const twice = (x, y) => x * y;', 'javascript', NULL, 18, 18),
          ('src/greet.js', 'block', 'function', 'export const block = (z) =>', NULL, ['z'], NULL, NULL, E'export const block = z => {\\n  return z;\\n};', 'javascript', NULL, 19, 21)
        ) AS s(path, name, kind, signature, doc, params, returned, deco, body, lang, methods, a, b))
        SELECT path || '::' || name AS source_id, upper(kind[1]) || kind[2:] || ': ' || name AS title,
          '# ' || name || E'\\n\\n**Signature:** `' || signature || E'`\\n\\n' || CASE WHEN doc IS NULL THEN '' ELSE E'## Documentation\\n\\n' || doc || E'\\n\\n' END
          || CASE WHEN params IS NULL THEN '' ELSE E'**Parameters:**\\n' || array_to_string(list_transform(params, lambda p: '- `' || p || '`'), E'\\n') || E'\\n\\n' END
          || CASE WHEN returned IS NULL THEN '' ELSE '**Returns:** `' || returned || E'`\\n\\n' END || CASE WHEN deco IS NULL THEN '' ELSE E'**Decorators:**\\n- `@' || deco || E'`\\n\\n' END
          || E'## Source Code\\n\\n```' || lang || E'\\n' || body || E'\\n```' AS content,
          path AS file_path, lang AS programming_language, kind AS entity_type, name AS entity_name, signature, array_to_string(params, ',') AS parameters, returned AS return_type, deco AS decorators, CAST(NULL AS VARCHAR) AS parent_entity, methods,
          doc IS NOT NULL AS has_docstring, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line FROM e""",
    "code_python_chunks": """
        WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, 'python' AS language, CAST(0 AS BIGINT) AS chunk_no, CAST(0 AS BIGINT) AS start_index, CAST(2 AS BIGINT) AS end_index FROM d
        UNION ALL SELECT doc_id, 'python', 1, 2, n + 5 FROM d
        UNION ALL SELECT doc_id, 'python', 2, n + 5, n + 6 FROM d
        UNION ALL SELECT doc_id, 'python', 3, n + 6, n + 8 FROM d""",
    "lang_detect": """
        SELECT doc_id, CASE WHEN lang = 'de' THEN 'typescript' WHEN lang = 'fr' THEN 'python' WHEN contains(b, 'def ') AND contains(b, ':') THEN 'python'
          WHEN contains(b, 'function ') OR contains(b, 'const ') OR contains(b, '=>') THEN 'javascript' WHEN contains(b, 'public class ') OR contains(b, 'private class ') THEN 'java' ELSE 'unknown' END AS language
        FROM (SELECT doc_id, lang, CASE WHEN lang = 'es' THEN 'const a = ' ELSE '' END || coalesce(text, '') AS b FROM documents)""",
    "repo_stats": """
        WITH g AS (SELECT lang AS language, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY lang)
        SELECT *, CAST(sum(files) OVER () AS BIGINT) AS total_files, CAST(sum(bytes) OVER () AS BIGINT) AS total_bytes, round(sum(bytes) OVER () / 1048576.0, 2) AS total_mb FROM g""",
    "vector_topk": f"""
        WITH p AS (SELECT e.vec_id, {_d2("e.embedding", "q.embedding")} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
        r AS (SELECT *, row_number() OVER (ORDER BY d, vec_id) AS rank FROM p)
        SELECT vec_id, rank, round(d, 6) AS distance, round(greatest(0.0, least(1.0, 1 - d / 2)), 6) AS score FROM r WHERE rank <= 5""",
    "vector_topk_batch": f"""
        WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, {_d2("e.embedding", "q.embedding")} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 5""",
    "vector_topk_cosine": f"""
        WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - {_cos("e.embedding", "q.embedding")} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) SELECT query_id, rank, vec_id, round(d, 6) + 0.0 AS distance FROM r WHERE rank <= 5""",
    "score_from_distance": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(d, 6) AS distance, round(CASE WHEN d IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, 1 - d / 2)) END, 6) AS score FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount * 30 END AS d FROM lineitem)",
    "threshold_after_topk": f"""
        WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, {_d2("e.embedding", "q.embedding")} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p)
        SELECT query_id, rank, vec_id, round(d, 6) AS distance, round(greatest(0.0, least(1.0, 1 - d / 2)), 6) AS score FROM r WHERE rank <= 5 AND greatest(0.0, least(1.0, 1 - d / 2)) >= 0.35""",
    "similarity_matrix": f"SELECT a.vec_id AS a, b.vec_id AS b, round({_cos('a.embedding', 'b.embedding')}, 6) AS cosine FROM embeddings a, embeddings b",
    "similar_pairs": f"SELECT a, b, round(cosine, 6) AS cosine FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_cos('a.embedding', 'b.embedding')} AS cosine FROM embeddings a, embeddings b) WHERE cosine >= 0.35",
    "similarity_01": f"""
        WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, {_cos("e.embedding", "q.embedding")} AS c FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, round((c + 1) / 2, 6) AS similarity FROM r WHERE rank <= 10""",
    "embedding_stats": f"""
        WITH n AS (SELECT vec_id, len(embedding) AS d, sqrt({_DOT.format("embedding", "embedding")}) AS n FROM embeddings)
        SELECT count(*) AS count, max(d) AS dimensions, round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm, round(arg_min(n, vec_id), 6) AS first_norm, 'float32' AS dtype, CAST(NULL AS VARCHAR) AS model FROM n""",
    "embedding_normalize": f"""
        WITH n AS (SELECT vec_id, label, embedding[1] AS f, sqrt({_DOT.format("embedding", "embedding")}) AS n FROM embeddings)
        SELECT vec_id, CASE WHEN label = 0 THEN 0.0 ELSE 1.0 END AS norm, round(CASE WHEN label = 0 THEN 0.0 ELSE CAST(f AS DOUBLE) / n END, 6) + 0.0 AS first FROM n""",
    "embedding_preview": f"""
        SELECT vec_id, array_to_string(list_transform(embedding[1:10], lambda x: printf('%.4f', CAST(x AS DOUBLE))), ', ') AS preview, len(embedding) AS dimensions, round(sqrt({_DOT.format("embedding", "embedding")}), 6) AS norm FROM embeddings""",
    "embed_documents": f"SELECT doc_id, CAST(256 AS BIGINT) AS dimensions, CASE WHEN text IS NULL OR {_strip('text')} = '' THEN 0.0 ELSE 1.0 END AS norm FROM documents",
    "filter_eq_in": "SELECT vec_id AS id, source AS domain, lang AS heading FROM embeddings JOIN documents ON vec_id = doc_id WHERE source IN ('src1', 'src2', 'src3') AND lang = 'en'",
    "filter_op_tree": "SELECT vec_id AS id, source AS domain, lang AS heading, CAST(label AS VARCHAR) AS label FROM embeddings JOIN documents ON vec_id = doc_id WHERE source = 'src1' OR (lang NOT IN ('en', 'de') AND NOT label >= 5)",
    "filter_post": _with_hits("SELECT query_id, rank, id FROM hits WHERE heading = 'en'", 10),
    "jaccard_pairs": _with_hits(f"""
        , w AS (SELECT query_id, id, {_WORDS} AS w FROM hits)
        SELECT a.query_id, a.id, b.id AS other, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) END, 6) AS jaccard FROM w a JOIN w b ON a.query_id = b.query_id AND a.id < b.id"""),
    "diversity_rescore": _with_hits(f"""
        , w AS (SELECT query_id, id, rank, score, {_WORDS} AS w FROM hits),
        j AS (SELECT a.query_id, a.id, a.rank, a.score, coalesce(max(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) END), 0.0) AS m
              FROM w a LEFT JOIN w b ON a.query_id = b.query_id AND a.rank > b.rank GROUP BY ALL),
        s AS (SELECT query_id, id, rank AS old_rank, score * (1 - m * 0.5) AS score FROM j)
        SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS rank, old_rank, round(score, 6) AS score FROM s"""),
    "retrieval_envelope": _with_hits("""
        SELECT qs.query_id, 'vector_similarity' AS retrieval_method, (SELECT count(*) FROM ix) AS total_candidates, (SELECT count(*) FROM hits WHERE hits.query_id = qs.query_id AND score >= 0.35) AS filtered_count, CAST(5 AS BIGINT) AS top_k FROM qs"""),
    "retrieval_display": _with_hits("""
        SELECT query_id, rank, CASE WHEN score = 0 THEN 'N/A' ELSE printf('%.3f', score) END AS score, title AS component, heading, CASE WHEN length(p) >= 80 THEN substr(p, 1, 77) || '...' ELSE p END AS preview
        FROM (SELECT *, replace(substr(content, 1, 80), chr(10), ' ') AS p FROM hits)"""),
    "context_build": _with_hits("SELECT query_id, string_agg('--- Source: ' || title || ' > ' || heading || ' ---' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM hits WHERE rank <= 3 GROUP BY query_id"),
    "sources_format": _with_hits("SELECT query_id, rank, title AS source, CASE WHEN score = 0 THEN 'N/A' ELSE printf('%.3f', score) END AS score, heading, 'doc/' || id AS url FROM hits"),
    "chat_format": """
        SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system'), '') AS system, count(*) FILTER (role <> 'system') AS n_messages,
          coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (role <> 'system'), '') AS conversation FROM conversations GROUP BY conv_id""",
    "turn_offsets": r"""
        WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(length(text), 0) AS size, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS n_words FROM conversations)
        SELECT *, CAST(coalesce(sum(size + 1) OVER w, 0) AS BIGINT) AS start, CAST(coalesce(sum(n_words) OVER w, 0) AS BIGINT) AS first_word FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "token_estimate": "SELECT conv_id, turn, length(text) // 4 AS tokens FROM conversations",
    "request_validation": f"SELECT conv_id, turn, CASE WHEN turn = 1 OR text IS NULL OR {_strip('text')} = '' THEN 'question is empty' WHEN turn * 12 < 1 OR turn * 12 > 50 THEN 'top_k must be from 1 to 50' END AS error FROM conversations",
    "page_meta": r"""
        SELECT page_id, trim(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS title, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
          nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1), '') AS path_segment, sha256(html) AS content_hash, md5(url) AS file FROM pages""",
    "url_allow": r"""
        SELECT page_id, (regexp_matches(url, '^https://.*/a') OR regexp_matches(url, '[0-9]\.html') OR regexp_matches(url, '^http.*://m\.')) AND NOT (regexp_matches(url, '\?utm') OR regexp_matches(url, '.utm') OR regexp_matches(url, '#top$')) AS allowed FROM pages""",
    "crawl_diff": f"WITH {_STATE} SELECT page_id, reason FROM df",
    "state_upsert": f"""
        WITH {_STATE}, fresh AS (SELECT url, content_hash, TIMESTAMP '2024-06-30 00:00:00' AS last_crawled, md5(url) || '.md' AS output_file FROM df WHERE reason <> 'unchanged'),
        u AS (SELECT *, 0 AS t FROM st UNION ALL SELECT *, 1 FROM fresh)
        SELECT url, content_hash, strftime(last_crawled, '%Y-%m-%d') AS crawled, output_file FROM u QUALIFY row_number() OVER (PARTITION BY url ORDER BY t DESC) = 1""",
    "bfs_frontier": """
        WITH RECURSIVE r AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS depth UNION SELECT t.id, r.depth + 1 FROM r, LATERAL (SELECT unnest([r.id * 2 + 1, r.id * 3 + 1]) AS id) t WHERE r.depth < 3)
        SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM r JOIN pages ON page_id = id GROUP BY url""",
    "index_upsert_overwrite": f"WITH {_KEYS} SELECT * FROM inc UNION ALL SELECT * FROM ex WHERE id NOT IN (SELECT id FROM inc)",
    "index_upsert_skip": f"WITH {_KEYS} SELECT * FROM ex UNION ALL SELECT * FROM inc WHERE id NOT IN (SELECT id FROM ex)",
    "index_stats": "SELECT lang AS domain, count(DISTINCT text) AS stored, CAST(0 AS BIGINT) AS other FROM documents GROUP BY lang",
    "index_merge_on_read": "SELECT DISTINCT sha256(text || chr(2) || 'domain=' || lang) AS id, lang AS domain, CASE WHEN lang = 'de' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS first FROM documents WHERE lang <> 'fr'",
    "index_compacted": "SELECT DISTINCT sha256(text || chr(2) || 'domain=' || lang) AS id, lang AS domain, CASE WHEN lang = 'de' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS first FROM documents",
    "refresh_index": """
        WITH a AS (SELECT DISTINCT sha256(text || chr(2) || 'domain=' || lang) AS id, text FROM documents),
        c AS (SELECT CASE WHEN doc_id % 100 = 0 THEN text || ' changed' ELSE text END AS text, lang FROM documents WHERE lang <> 'fr'),
        b AS (SELECT DISTINCT sha256(text || chr(2) || 'domain=' || lang) AS id, lang AS domain, text FROM c)
        SELECT id, domain, CAST(64 AS BIGINT) AS dimensions, (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS added,
               (SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM b)) AS deleted, (SELECT count(DISTINCT text) FROM b WHERE text NOT IN (SELECT text FROM a)) AS encoded FROM b""",
    "cell_topk": f"""
        WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, {_d2("e.embedding", "q.embedding")} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 5""",
    "incremental_scan": "SELECT event_id, user_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'",
    "stream_index": "SELECT DISTINCT sha256(text || chr(2) || 'domain=' || lang) AS id, lang AS domain FROM documents",
    "code_entities": f"""
        WITH {_LINES} SELECT replace(path, '.', '_' || doc_id || '.') AS path, t.* EXCLUDE (path, start_line, end_line), start_line + above AS start_line, end_line + above AS end_line FROM lines, (VALUES
          ('src/store.py', 0, 'total', 'function', 5, 7, 'def total(a, b) -> int', 'a,b', NULL),
          ('src/store.py', 1, 'Store', 'class', 11, 18, 'class Store(Base)', NULL, 'put'),
          ('src/store.py', 2, 'put', 'function', 14, 15, 'def put(self, key, value)', 'self,key,value', NULL),
          ('src/greet.js', 0, 'greet', 'function', 7, 10, 'export async function greet(name, times = 2)', 'name,times', NULL),
          ('src/greet.js', 1, 'Counter', 'class', 12, 16, 'class Counter extends Base', NULL, NULL),
          ('src/greet.js', 2, 'twice', 'function', 18, 18, 'const twice = (x, y) =>', 'x,y', NULL),
          ('src/greet.js', 3, 'block', 'function', 19, 21, 'export const block = (z) =>', 'z', NULL)
        ) AS t(path, entity_no, name, entity_type, start_line, end_line, signature, parameters, methods)""",
    "code_imports": """
        SELECT replace(path, '.', '_' || doc_id || '.') AS path, statement FROM documents, (VALUES ('src/store.py', 'import os'), ('src/store.py', 'from typing import List, Dict'), ('src/greet.js', 'import React from ''react'''), ('src/greet.js', 'const fs = require(''fs'')')) AS t(path, statement)""",
    "string_functions": r"""
        SELECT doc_id, upper(substr(source, 1, 1)) || lower(substr(source, 2)) AS capital, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS BIGINT) AS n_th,
          CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS cut, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS n_words, source AS stripped,
          CASE WHEN n_chars = 0 THEN 'N/A' ELSE printf('%.3f', n_chars / 7.0) END AS fixed FROM documents""",
}
