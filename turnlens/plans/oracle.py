"""The canonical views as DuckDB common table expressions."""

from __future__ import annotations

TOKENS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'))"


def tokens(expr: str) -> str:
    return TOKENS.format(expr)


def share(part: str, whole: str) -> str:
    return f"(CASE WHEN len({part}) = 0 THEN 0.0 ELSE len(list_intersect({part}, {whole})) / len({part}) END)"


def slug(expr: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower({expr}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'entity')"


_TYPES = "['Seed', 'Follow-Up', 'Clarification', 'Comparative', 'Correction', 'Topic Shift', 'Unanswerable', 'Multi-Hop', 'Ambiguous Reference']"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "bench": ((), "SELECT item_id, substring(text, 1, length(text) // 2) AS question, substring(text, length(text) // 2 + 1) AS gold, text FROM benchmark"),
    "chunks": (
        (),
        """SELECT doc_id * 1048576 + pos AS chunk_id, doc_id, pos, text FROM (
             SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS pos FROM (
               SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda p: regexp_replace(trim(p), '[ \\t\\n\\f\\r]{2,}', ' ', 'g')), lambda p: length(p) > 80) AS ps FROM documents))""",
    ),
    "postings": (("chunks",), f"SELECT chunk_id, unnest({tokens('text')}) AS token FROM chunks"),
    "idf": (("postings",), "SELECT token, df, ln((n + 1) / (df + 1)) + 1 AS idf FROM (SELECT token, count(*) AS df FROM postings GROUP BY token), (SELECT count(*) AS n FROM chunks)"),
    "query_tokens": (("bench",), f"SELECT item_id, unnest({tokens('question')}) AS token FROM bench"),
    "hits": (
        ("query_tokens", "postings", "idf"),
        """SELECT item_id, chunk_id, score, rank FROM (
             SELECT item_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, chunk_id DESC) AS rank
             FROM (SELECT item_id, chunk_id, sum(idf) AS score FROM query_tokens JOIN postings USING (token) JOIN idf USING (token) GROUP BY ALL))""",
    ),
    "top5": (("hits", "chunks"), "SELECT item_id, rank, chunk_id, score, text FROM hits JOIN chunks USING (chunk_id) WHERE rank <= 5"),
    "answers": (
        ("top5", "bench"),
        f"""SELECT item_id, b.question, b.gold, coalesce(nullif(a.answer, ''), substring(f.text, 1, 200), 'I don''t know.') AS answer FROM bench b
            LEFT JOIN (
              SELECT item_id, sent AS answer FROM (
                SELECT item_id, trim(sent) AS sent, row_number() OVER (PARTITION BY item_id ORDER BY len(list_intersect(q, {tokens('sent')})) DESC, rank, spos) AS rn, len(list_intersect(q, {tokens('sent')})) AS score
                FROM (SELECT item_id, {tokens('question')} AS q, rank, unnest(ss) AS sent, generate_subscripts(ss, 1) AS spos FROM
                        (SELECT item_id, question, rank, string_split(regexp_replace(t.text, '([.!?])[ \\t\\n\\f\\r]+', '\\1␞', 'g'), '␞') AS ss FROM top5 t JOIN bench USING (item_id))))
              WHERE rn = 1 AND score > 0) a USING (item_id)
            LEFT JOIN top5 f ON f.item_id = b.item_id AND f.rank = 1""",
    ),
    "msgs": ((), "SELECT * FROM conversations"),
    "qa_turns": (
        (),
        """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_id, question, text AS gold FROM (
             SELECT *, lag(role) OVER w AS prev, lag(text) OVER w AS question FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
           WHERE role = 'assistant' AND prev = 'user'""",
    ),
    "vecs": ((), "SELECT vec_id, embedding::DOUBLE[] AS emb, label FROM embeddings"),
    "log": (
        (),
        f"""SELECT *, CASE WHEN turn_id > 0 THEN CASE WHEN value * 7 - floor(value * 7) < 0.6 THEN 'correct' ELSE 'wrong' END END AS cf_outcome FROM (
              SELECT user_id AS conversation_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn_id,
                CASE WHEN event_type IN ('view', 'click') THEN 'correct' WHEN event_type = 'purchase' THEN 'wrong' WHEN event_type = 'error' THEN 'hallucinated' ELSE 'abstained' END AS outcome,
                ({_TYPES})[event_id % 9 + 1] AS query_type, user_id % 4 AS rag, user_id % 3 AS dataset, value, event_id FROM events)""",
    ),
    "raters": ((), "SELECT doc_id, lang, source, quality::BIGINT AS a, toxic::BIGINT AS b FROM labels JOIN documents USING (doc_id)"),
    "kg_nodes": (
        (),
        " UNION ALL ".join(f"SELECT {slug(c)} AS id, {c} AS entity, '{t}' AS type FROM {t}" for t, c in (("region", "r_name"), ("nation", "n_name"), ("supplier", "s_name"), ("customer", "c_name"))),
    ),
    "kg_edges": (
        (),
        f"""SELECT {slug('n_name')} AS source, {slug('r_name')} AS target, 'part_of' AS relation FROM nation JOIN region ON n_regionkey = r_regionkey
            UNION ALL SELECT {slug('s_name')}, {slug('n_name')}, 'located_in' FROM supplier JOIN nation ON s_nationkey = n_nationkey
            UNION ALL SELECT {slug('c_name')}, {slug('n_name')}, 'located_in' FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
}


def sql(body: str, *views: str, more: dict[str, str] | None = None, once: bool = False) -> str:
    """``body`` under a WITH clause that defines the views it needs, then ``more``; ``once`` computes each of them a single time."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in VIEWS[name][0]:
            need(n)
        if name not in order:
            order.append(name)

    for v in views:
        need(v)
    how = "AS MATERIALIZED" if once else "AS"
    parts = [f"{v} {how} ({VIEWS[v][1]})" for v in order] + [f"{k} {how} ({v})" for k, v in (more or {}).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def wilson(k: str, n: str) -> tuple[str, str]:
    p, z = f"({k} / {n})", "1.96"
    d = f"(1 + {z} * {z} / {n})"
    centre = f"(({p} + {z} * {z} / (2 * {n})) / {d})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})) / {d})"
    zero = lambda x: f"CASE WHEN {n} > 0 THEN {x} ELSE 0.0 END"
    return zero(f"greatest(0.0, {centre} - {half})"), zero(f"least(1.0, {centre} + {half})")


def erfc(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * {x}))"
    return f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({x}) * ({x})))"


def two_z(k1: str, n1: str, k2: str, n2: str) -> tuple[str, str]:
    p = f"(({k1} + {k2}) / ({n1} + {n2}))"
    se = f"sqrt({p} * (1 - {p}) * (1 / {n1} + 1 / {n2}))"
    ok = f"{n1} > 0 AND {n2} > 0 AND ({k1} + {k2}) > 0 AND ({k1} + {k2}) < ({n1} + {n2})"
    z = f"(({k1} / {n1} - {k2} / {n2}) / {se})"
    return f"CASE WHEN {ok} THEN {z} ELSE 0.0 END", f"CASE WHEN {ok} THEN {erfc(f'(abs({z}) / sqrt(2.0))')} ELSE 1.0 END"


def mcnemar(b: str, c: str) -> tuple[str, str]:
    chi = f"(power(abs({b} - {c}) - 1, 2) / ({b} + {c}))"
    return f"CASE WHEN {b} + {c} > 0 THEN {chi} ELSE 0.0 END", f"CASE WHEN {b} + {c} > 0 THEN {erfc(f'sqrt({chi} / 2)')} ELSE 1.0 END"


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def in_(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
