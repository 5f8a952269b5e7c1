"""DuckDB SQL for the registered queries, put together from named parts.

Stop words are the engine's own, as data; everything else is written out here. Sums whose order could show are over
whole numbers or ordered lists.
"""

from __future__ import annotations

from notegrove.functions.stopwords import RERANK_STOP_WORDS, STOP_WORDS

PREFERENCE_WORDS = "advice recommend recommendation recommendations suggest suggestion suggestions tips prefer prefers preferred preference interest interested enjoy enjoyed enjoying favorite favorites favourite favourites".split()
PREFERENCE_PHRASES = ("what kind", "what type", "what sort", "what do i", "what is my", "what are my")
NUMBER_WORDS = tuple(zip("a couple of,a couple,couple of,a few,couple,few,one,two,three,four,five,six,seven,eight,nine,ten,eleven,twelve".split(","), (2, 2, 2, 3, 2, 3, *range(1, 13)), strict=True))
#: (pattern, days, tolerance); # stands for the number.
OFFSETS = (
    (r"(\d+)\s+days?\s+ago", "#", 2), ("yesterday", "1", 1), (r"(\d+)\s+weeks?\s+ago", "# * 7", 5), (r"a\s+week\s+ago", "7", 3), (r"last\s+week", "7", 3), (r"(\d+)\s+months?\s+ago", "# * 30", 10),
    (r"a\s+month\s+ago", "30", 7), (r"last\s+month", "30", 7), (r"a\s+year\s+ago", "365", 30), (r"last\s+year", "365", 30), ("recently", "14", 14),
)
NOW = "DATE '2028-01-01'"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _chunking(name: str, most: int, overlap: int) -> dict[str, str]:
    count = "len([x FOR x IN {s} IF x <= {v}]) - 1"
    first = count.format(s="sums", v=most)
    back = count.format(s="a.sums", v=f"a.sums[w.en + 1] - {overlap}") if overlap else "w.en"
    return {
        f"{name}_pieces": f"SELECT doc_id, line_no , pos0, substring(line, (pos0 + 1)::INT, {most}) AS piece FROM (SELECT doc_id, line, line_no, unnest(range(0, greatest(length(line), 1), {most})) AS pos0 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents))",
        f"{name}_sums": f"SELECT doc_id, line_no, piece, row_number() OVER w AS i, sum(length(piece) + 1) OVER w AS s FROM {name}_pieces WINDOW w AS (PARTITION BY doc_id ORDER BY line_no, pos0 ROWS UNBOUNDED PRECEDING)",
        f"{name}_docs": f"SELECT doc_id, count(*) AS n, list_prepend(0::HUGEINT, list(s ORDER BY i)) AS sums, list(line_no ORDER BY i) AS ln, list(piece ORDER BY i) AS ps FROM {name}_sums GROUP BY doc_id",
        f"{name}_walk": f"SELECT doc_id, 0 AS no, 0::BIGINT AS st, greatest(1, {first})::BIGINT AS en FROM {name}_docs UNION ALL SELECT doc_id, no, ks::BIGINT, greatest(en + 1, len([x FOR x IN sums IF x <= sums[ks + 1] + {most}]) - 1)::BIGINT FROM (SELECT w.doc_id, w.no + 1 AS no, greatest(w.st, {back}) AS ks, w.en AS en, a.sums AS sums FROM {name}_walk w JOIN {name}_docs a USING (doc_id) WHERE w.en < a.n)",
        f"{name}_bare": f"SELECT w.doc_id, w.no AS chunk_no, a.ln[w.st + 1]::INT AS start_line, a.ln[w.en]::INT AS end_line, array_to_string(a.ps[w.st + 1 : w.en], chr(10)) AS text FROM {name}_walk w JOIN {name}_docs a USING (doc_id)",
        name: f"SELECT lpad(doc_id::VARCHAR, 12, '0') || ':' || lpad(chunk_no::VARCHAR, 6, '0') AS chunk_id, b.*, f.path, f.source FROM {name}_bare b JOIN files f USING (doc_id)",
    }


WORD = r"'[\p{L}\p{N}_]+'"
TOKENS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
STOP, RERANK = _list(STOP_WORDS), _list(RERANK_STOP_WORDS)
KEYWORD = r"(w <> '' AND NOT regexp_full_match(w, '[a-zA-Z]{1,2}') AND NOT regexp_full_match(w, '\p{Nd}+'))"


def topic(column: str) -> str:
    return rf"[w FOR w IN regexp_extract_all(lower({column}), {WORD}) IF regexp_full_match(w, '[a-z]{{3,}}') AND NOT list_contains({RERANK}, w)]"


def ordered_distinct(items: str) -> str:
    return f"list_transform(list_sort(list_transform(list_distinct({items}), lambda x: {{'at': list_position({items}, x), 'x': x}})), lambda s: s.x)"


def keyword_list(column: str) -> str:
    kept = f"[w FOR w IN regexp_extract_all({column}, {WORD}) IF {KEYWORD} AND NOT list_contains({STOP}, lower(w)) AND NOT list_contains({STOP}, w)]"
    lowered = f"[lower(w) FOR w IN {kept}]"
    return f"list_transform({ordered_distinct(lowered)}, lambda w: {kept}[list_position({lowered}, w)])"


def entity_parts(name: str, source: str) -> dict[str, str]:
    """Parts that end in `name` (id, e): quoted phrases, runs of capitalised words, acronyms, hyphenated words of source (id, text)."""
    one = r"[\p{L}\p{N}_]+"
    run = lambda word, gap: f"SELECT id, i, p, gap, starts, sum(starts) OVER (PARTITION BY id ORDER BY i) AS g FROM (SELECT *, CASE WHEN regexp_full_match(gap, '{gap}') AND regexp_full_match(before, '{word}') THEN 0 ELSE 1 END AS starts FROM {name}_words WHERE regexp_full_match(p, '{word}'))"
    joined = lambda kind, rows: f"SELECT id, {kind} AS kind, min(i) AS i, lower(string_agg(CASE WHEN starts = 1 THEN p ELSE gap || p END, '' ORDER BY i)) AS e FROM {rows} GROUP BY id, g HAVING count(*) > 1"
    return {
        f"{name}_source": source,
        f"{name}_pieces": f"SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT id, regexp_extract_all(text, '{one}|[^\\p{{L}}\\p{{N}}_]+') AS ps FROM {name}_source)".replace("\\\\", "\\"),
        f"{name}_words": f"SELECT * FROM (SELECT *, lag(p, 1, '') OVER w AS gap, lag(p, 2, '') OVER w AS before FROM {name}_pieces WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE regexp_full_match(p, '{one}')",
        f"{name}_caps": run("[A-Z][A-Za-z]+", r"\s+"),
        f"{name}_hyphens": run("[A-Za-z]{2,}", "-"),
        f"{name}_all": f"""SELECT id, 1 AS kind, generate_subscripts(q, 1) AS i, lower(unnest(q)) AS e FROM (SELECT id, regexp_extract_all(text, '"([^"]+)"', 1) AS q FROM {name}_source) UNION ALL {joined(2, name + "_caps")} UNION ALL SELECT id, 3, i, lower(p) FROM {name}_words WHERE regexp_full_match(p, '[A-Z]{{2,}}') UNION ALL {joined(4, name + "_hyphens")}""",
        name: f"SELECT id, list(e ORDER BY place) AS e FROM (SELECT id, e, min(kind::BIGINT * 1000000000 + i) AS place FROM {name}_all GROUP BY id, e) GROUP BY id",
    }


def offset(column: str, which: int) -> str:
    """Days (1) or tolerance (2) that a text with digits reaches back; null for none."""
    value = lambda row: str(row[which]).replace("#", f"regexp_extract({column}, '{row[0]}', 1, 'i')::BIGINT")
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{row[0]}', 'i') THEN {value(row)}" for row in OFFSETS) + " END"


PARTS: dict[str, str] = {
    "files": "SELECT doc_id, path, CASE WHEN len(string_split(path, '/')) = 2 THEN 'memory' ELSE string_split(path, '/')[2] END AS source, hash, mtime, size, text FROM (SELECT doc_id, 'memory/' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE source || '/' END || CASE WHEN doc_id % 3 = 0 THEN strftime(DATE '2000-01-01' + doc_id::INT, '%Y-%m-%d') ELSE 'doc_' || doc_id END || '.md' AS path, sha256(text) AS hash, epoch((DATE '2000-01-01' + doc_id::INT)::TIMESTAMP)::DOUBLE AS mtime, strlen(text)::BIGINT AS size, text FROM documents)",
    **_chunking("chunks", 1600, 320),
    **_chunking("small", 160, 32),
    "nvec": "SELECT count(*) AS n FROM embeddings",
    "embedded": "SELECT c.*, e.embedding FROM chunks c CROSS JOIN nvec JOIN embeddings e ON e.vec_id = (c.doc_id + c.chunk_no) % nvec.n",
    "queries": r"SELECT item_id::VARCHAR AS query_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(string_split_regex(text, '\s+')), lambda w: {'n': -length(w), 'w': w}))[1:2], lambda s: s.w), ' ') AS query, text AS item, embedding AS vec FROM benchmark CROSS JOIN nvec JOIN embeddings ON vec_id = item_id % nvec.n",
    "tokens": f"SELECT chunk_id, len(t) AS dl, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT chunk_id, {TOKENS.format('text')} AS t FROM chunks)",
    "stats": f"SELECT count(*) AS n, avg(len({TOKENS.format('text')})) AS avgdl FROM chunks",
    "phrases": f"SELECT query_id, no, p, len(p) AS length FROM (SELECT query_id, unnest(w) AS p, generate_subscripts(w, 1) AS no FROM (SELECT query_id, list_transform(regexp_extract_all(query, {WORD}), lambda x: {TOKENS.format('x')}) AS w FROM asked))",
    "terms": "SELECT query_id, no, length, unnest(p) AS term, generate_subscripts(p, 1) AS k FROM phrases",
    "begun": "SELECT query_id, no, length, chunk_id, dl, pos - k AS pos0, count(*) AS got FROM tokens JOIN terms USING (term) GROUP BY ALL",
    "freq": "SELECT query_id, no, chunk_id, dl, count(*) AS f, count(*) OVER (PARTITION BY query_id, no) AS n_p FROM begun WHERE got = length GROUP BY query_id, no, chunk_id, dl",
    "weighed": "SELECT query_id, chunk_id, -sum(round(1e12 * CASE WHEN ln((n - n_p + 0.5) / (n_p + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n_p + 0.5) / (n_p + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)))::BIGINT)::DOUBLE / 1e12 AS rank, count(*) AS met FROM freq CROSS JOIN stats GROUP BY query_id, chunk_id",
    "wanted": "SELECT query_id, count(*) AS n_phrases FROM phrases GROUP BY query_id",
    "bm25": "SELECT query_id, chunk_id, CASE WHEN rank < 0 THEN -rank / (1 - rank) ELSE 1 / (1 + rank) END AS score FROM weighed JOIN wanted USING (query_id) WHERE met = n_phrases",
    "cosines": "SELECT q.query_id, c.chunk_id, list_cosine_similarity(c.embedding::DOUBLE[], q.vec::DOUBLE[]) AS score FROM embedded c CROSS JOIN queries q",
    "vec96": "SELECT * FROM cosines QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 96",
    "key96": "SELECT * FROM bm25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 96",
    "merged": "SELECT query_id, chunk_id, 0.7 * coalesce(v.score, 0) + 0.3 * coalesce(k.score, 0) AS score, coalesce(v.score, 0) AS vector_score, coalesce(k.score, 0) AS text_score FROM vec96 v FULL JOIN key96 k USING (query_id, chunk_id)",
    "cand": "SELECT m.*, c.path, c.source, c.start_line, c.end_line, c.text, q.item AS query FROM (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 24) m JOIN chunks c USING (chunk_id) JOIN queries q USING (query_id)",
    "asked": "SELECT query_id, query FROM queries",
    "sessions": "SELECT 's' || conv_id AS session_id, strftime(DATE '2024-01-01' + conv_id::INT, '%Y/%m/%d') AS date, turn, role, text FROM conversations",
    "notes": r"SELECT session_id, '# Session: ' || session_id || chr(10) || 'Date: ' || date || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM sessions WHERE role = 'user' GROUP BY session_id, date",
    "stored": "SELECT path, source, CASE WHEN quality = 0 THEN sha256(hash || 'old') ELSE hash END AS hash, mtime - quality + 1 AS mtime, size FROM files JOIN labels USING (doc_id) UNION ALL SELECT 'memory/sessions/' || session_id || '.md', 'sessions', sha256(session_id), 0.0, 0 FROM (SELECT DISTINCT session_id FROM sessions)",
}
_PREFERENCE = f"(list_has_any(regexp_extract_all(lower(query), {WORD}), {_list(PREFERENCE_WORDS)}) OR " + " OR ".join(f"contains(lower(query), '{p}')" for p in PREFERENCE_PHRASES) + ")"
PARTS |= {
    "maxvs": "SELECT *, max(vector_score) OVER (PARTITION BY query_id) AS most FROM cand",
    "doubted": "SELECT *, 1 - vector_score / CASE WHEN most > 0 THEN most ELSE 1 END AS doubt FROM maxvs",
    **entity_parts("named", "SELECT query_id AS id, item AS text FROM queries"),
    **entity_parts("doc_entities", "SELECT doc_id AS id, text FROM documents"),
    "sought": f"SELECT query_id, coalesce(e, {topic('query')}) AS e, {_PREFERENCE} AS skip FROM (SELECT query_id, item AS query FROM queries) LEFT JOIN named ON id = query_id",
    "entity": "SELECT d.* REPLACE (CASE WHEN skip OR len(e) = 0 THEN score ELSE least(1.0, score + 0.3 * doubt * len([x FOR x IN e IF contains(lower(text), x)]) / len(e)) END AS score) FROM doubted d JOIN sought USING (query_id)",
    "pathstem": "SELECT *, regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '') AS session FROM cand",
    "vocab": f"SELECT DISTINCT query_id, unnest({topic('item')}) AS term, false AS pair FROM queries",
    "have": f"SELECT query_id, session, lower(whole) AS low, list_distinct({topic('whole')}) AS have FROM (SELECT query_id, session, string_agg(text, ' ' ORDER BY score DESC, chunk_id) AS whole FROM pathstem GROUP BY query_id, session)",
    "idf": "SELECT query_id, term, pair, ln((SELECT count(*) FROM have h WHERE h.query_id = v.query_id) / (1.0 + (SELECT count(*) FROM have h WHERE h.query_id = v.query_id AND CASE WHEN pair THEN contains(h.low, v.term) ELSE list_contains(h.have, v.term) END))) AS idf FROM vocab v",
    "sumidf": "SELECT query_id, list_sum(list(idf ORDER BY term, pair)) AS total FROM idf GROUP BY query_id",
    "own": f"SELECT query_id, chunk_id, lower(text) AS low, list_distinct({topic('text')}) AS own FROM cand",
    "found": "SELECT query_id, chunk_id, list_sum(list(idf ORDER BY term, pair)) AS found FROM own JOIN idf USING (query_id) WHERE CASE WHEN pair THEN contains(low, term) ELSE list_contains(own, term) END GROUP BY query_id, chunk_id",
    "rarity": "SELECT c.* REPLACE (CASE WHEN total > 0 THEN least(1.0, score * (1 + 0.6 * coalesce(found, 0) / total)) ELSE score END AS score) FROM cand c LEFT JOIN sumidf USING (query_id) LEFT JOIN found USING (query_id, chunk_id)",
}
_TOPICS = topic("item")
#: Single words and pairs of neighbours as one query's terms.
PAIRS = f"SELECT DISTINCT query_id, unnest({_TOPICS}) AS term, false AS pair FROM queries UNION ALL SELECT DISTINCT query_id, unnest([{_TOPICS}[i] || ' ' || {_TOPICS}[i + 1] FOR i IN range(1, len({_TOPICS}))]), true FROM queries"


def digits(column: str) -> str:
    """Written numbers as digits, longest spelling first."""
    for words, number in sorted(NUMBER_WORDS, key=lambda x: -len(x[0])):
        column = rf"regexp_replace({column}, '\b{words}\b', '{number}', 'gi')"
    return column


#: Boosts one after the other, for every setting in `grid` (ec, idf, date); the day asked of is that of a question.
CHAIN = {
    "dates": rf"SELECT query_id, DATE '2024-02-20' - ({offset('q', 1)})::INT AS target, {offset('q', 2)} AS tol FROM (SELECT query_id, {digits('item')} AS q FROM queries)",
    "chained1": "SELECT d.* REPLACE (CASE WHEN skip OR len(e) = 0 THEN score ELSE least(1.0, score + ec * doubt * len([x FOR x IN e IF contains(lower(text), x)]) / len(e)) END AS score), ec, idf AS idf_a, date AS date_a FROM doubted d JOIN sought USING (query_id) CROSS JOIN grid",
    "chained2": "SELECT c.* REPLACE (CASE WHEN total > 0 THEN least(1.0, score * (1 + idf_a * coalesce(found, 0) / total)) ELSE score END AS score) FROM chained1 c LEFT JOIN sumidf USING (query_id) LEFT JOIN found USING (query_id, chunk_id)",
    "chained3": r"SELECT * REPLACE (CASE WHEN near > 0 THEN least(1.0, score + date_a * doubt * near) ELSE score END AS score) FROM (SELECT c.*, CASE WHEN target IS NULL OR day IS NULL THEN 0.0 WHEN abs(day - target) <= tol THEN 1.0 WHEN abs(day - target) <= 3 * tol THEN 1 - (abs(day - target) - tol) / (2.0 * tol) ELSE 0.0 END AS near FROM (SELECT *, try_cast(regexp_replace(nullif(regexp_extract(text, 'Date:\s*(\d{4}[/-]\d{2}[/-]\d{2})', 1), ''), '/', '-', 'g') AS DATE) AS day FROM chained2) c LEFT JOIN dates USING (query_id))",
}


def sql(select: str) -> str:
    """The query with the parts that it needs, directly or through others, in an order that works."""
    import re

    order: list[str] = []

    def need(text: str, own: str = "") -> None:
        for name in re.findall(r"(?:FROM|JOIN)\s+([a-z_0-9]+)", text):
            if name in PARTS and name not in order and name != own:
                need(PARTS[name], name)
                if name not in order:
                    order.append(name)

    need(select)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({PARTS[n]})" for n in order) + " " + select if order else select
