"""SQL that the corpus queries must equal, where SQL can express them over whole tables in reasonable time.

The other queries have no SQL: op1 needs the places of matches, op2, op5 and op6 are trained, op4 needs
a tokenizer, op10 names one of several earlier places, and op12 needs eigenvectors. Tests hold those
against plain versions.
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _crc32(text: str) -> str:
    """The unsigned CRC of an ASCII text, bit by bit."""
    bits = (
        f"flatten(list_transform(string_split({text}, ''), "
        "lambda c: list_transform(range(8), lambda k: (CAST(ascii(c) AS BIGINT) >> k) & 1)))"
    )
    step = "lambda c, b: xor(c >> 1, CAST(3988292384 AS BIGINT) * (xor(c, b) & 1))"
    return f"xor(list_reduce({bits}, {step}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def _levels(name: str, depth: int) -> str:
    """Tables name1 ... of a tree's levels above name0, and name0_sides ... with each node's siblings."""
    out = []
    for k in range(depth):
        out.append(f"""{name}{k + 1} AS (
            SELECT g, p // 16 AS p, (n + 15) // 16 AS n,
                   CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h
            FROM {name}{k} GROUP BY g, p // 16, n
        )""")
        sides = ", ".join(
            f"coalesce(string_agg(h, '') OVER (PARTITION BY g, p // 16 ORDER BY p ROWS BETWEEN {frame}), '') AS {side}"
            for side, frame in (
                ("before", "UNBOUNDED PRECEDING AND 1 PRECEDING"),
                ("after", "1 FOLLOWING AND UNBOUNDED FOLLOWING"),
            )
        )
        out.append(f"{name}{k}_sides AS (SELECT g, p, n, {sides} FROM {name}{k})")
    return ",\n        ".join(out)


def _merkle(leaf_levels: int = 6, source_levels: int = 4) -> str:
    """Trees of at most 16^6 rows a source and 16^4 sources; a level of one node stays as it is."""
    def encoded(columns: list[str]) -> str:
        texts = [f"CAST({c} AS VARCHAR)" for c in columns]
        return " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts)

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = ["doc_id", "source", "lang", "n_chars"]
    steps = [("a", k) for k in range(leaf_levels)] + [("b", k) for k in range(source_levels)]
    joins = []
    for name, k in steps:
        at, g = (f"a0.p // {16**k}", "a0.g") if name == "a" else (f"b0.p // {16**k}", "b0.g")
        joins.append(f"JOIN {name}{k}_sides AS {name}s{k} ON {name}s{k}.g = {g} AND {name}s{k}.p = {at}")
    folded = []
    for i, (name, k) in enumerate(steps):
        x, one = ("other" if i == 0 else f"f{i - 1}"), f"n_{name}{k}"
        table = "paths" if i == 0 else f"fold{i - 1}"
        fold = f"CASE WHEN {one} = 1 THEN {x} ELSE sha256(before_{name}{k} || {x} || after_{name}{k}) END"
        folded.append(f"fold{i} AS (SELECT *, {fold} AS f{i} FROM {table})")
    sides = ", ".join(
        f"{n}s{k}.n AS n_{n}{k}, {n}s{k}.before AS before_{n}{k}, {n}s{k}.after AS after_{n}{k}" for n, k in steps
    )
    proof = " || ".join(f"before_{n}{k} || after_{n}{k}" for n, k in steps)
    last = len(steps) - 1
    return f"""
        WITH d AS (
            SELECT doc_id, coalesce(':' || source, '') AS g, sha256({encoded([*rest, "text"])}) AS leaf,
                   CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0
                        THEN sha256({encoded([*rest, low])}) END AS other
            FROM documents
        ),
        a0 AS (
            SELECT doc_id, g, leaf AS h, coalesce(other, leaf) AS other, count(*) OVER (PARTITION BY g) AS n,
                   row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p
            FROM d
        ),
        {_levels("a", leaf_levels)},
        b0 AS (
            SELECT '' AS g, g AS source, h, count(*) OVER () AS n, row_number() OVER (ORDER BY g) - 1 AS p
            FROM a{leaf_levels}
        ),
        {_levels("b", source_levels)},
        paths AS (
            SELECT a0.doc_id, a0.h AS leaf, a0.other, b0.h AS subroot, b{source_levels}.h AS root, {sides}
            FROM a0 JOIN b0 ON b0.source = a0.g CROSS JOIN b{source_levels}
            {" ".join(joins)}
        ),
        {", ".join(folded)}
        SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f{last} AS folded_root,
               f{last} = root AS verified
        FROM fold{last}
    """


ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACED}) AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
        ),
        links AS (
            SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
            WHERE 100 * k >= 85 * (a.n + b.n - k)
        ),
        steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(doc_id, r) AS (
            SELECT doc_id, doc_id FROM d
            UNION
            SELECT reach.doc_id, steps.y FROM reach JOIN steps ON reach.r = steps.x
        ),
        sets AS (SELECT doc_id, md5(string_agg(s, chr(31) ORDER BY s)) AS id FROM shingles GROUP BY doc_id),
        equal AS (SELECT doc_id, count(*) OVER (PARTITION BY id) AS n_equal FROM sets),
        others AS (
            SELECT x AS doc_id, count(DISTINCT b.id) AS n_links
            FROM steps JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE a.id <> b.id GROUP BY x
        )
        SELECT reach.doc_id, coalesce(max(n), 0) AS n_shingles, min(r) AS component_id,
               coalesce(max(n_equal), 1) AS n_equal, coalesce(max(n_links), 0) AS n_links
        FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.doc_id
        LEFT JOIN equal ON equal.doc_id = reach.doc_id LEFT JOIN others ON others.doc_id = reach.doc_id
        GROUP BY reach.doc_id
    """,
    "op7_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
        items AS (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s
            FROM (
                SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p
                FROM items WHERE len(w) > 0
            )
        ),
        places AS (
            SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
            FROM (
                SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
                FROM d, (SELECT DISTINCT n FROM windows)
            )
        ),
        found AS (SELECT doc_id, p, n, item_id FROM places JOIN windows USING (n, s)),
        hit AS (
            SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM found)
            GROUP BY doc_id
        ),
        listed AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
    """,
    "op8_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS size,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256
        FROM n
        WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id)
    """,
    "op9_substring_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
        windows AS (
            SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)
        ),
        later AS (
            SELECT doc_id, p
            FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM windows)
            WHERE r > 1
        ),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM later),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        kept AS (
            SELECT words.doc_id, count(*) AS n, count(gone.i) AS g,
                   string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS s
            FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i GROUP BY words.doc_id
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(g, 0) AS n_removed,
               sha256(coalesce(s, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
    """,
    "op11_merkle_manifest": _merkle(),
    "op13_source_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS draw,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
            FROM documents
        ),
        sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
            FROM d GROUP BY source
        ),
        -- sources by how soon they are full: one is clamped if its cap is below its share of what
        -- the fuller ones leave
        filled AS (
            SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER fuller, 0) AS budget,
                   sum(weight) OVER () - coalesce(sum(weight) OVER fuller, 0) AS weights
            FROM sources
            WINDOW fuller AS (
                ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
            )
        ),
        clamped AS (SELECT *, 3 * source_size * weights < budget * weight AS over FROM filled),
        brim AS (SELECT max(budget) AS budget, max(weights) AS weights FROM clamped WHERE NOT over),
        targets AS (
            SELECT source, source_size,
                   CASE WHEN over THEN CAST(3 * source_size AS DOUBLE)
                        ELSE CAST(brim.budget AS DOUBLE) * weight / CAST(brim.weights AS DOUBLE) END AS target
            FROM clamped, brim
        ),
        places AS (
            SELECT doc_id, size, source_size, target,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                   CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
            FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source
        ),
        parts AS (
            SELECT *, greatest(0, least(size, floor(target + 0.5) - whole * source_size - before)) AS part FROM places
        )
        SELECT doc_id, size, source_size, target, CAST(whole * size + part AS BIGINT) AS taken,
               CAST(whole AS BIGINT) AS whole, CAST(part AS BIGINT) AS part
        FROM parts
    """,
}
