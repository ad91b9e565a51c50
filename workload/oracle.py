"""The same results in plain SQL, written relationally: lists are rows, order is a column."""

from __future__ import annotations

from tagloom import constants as C
from tagloom.plans.prompts import REASONS
from tagloom.sources.readers import GROUP_FILES
from workload.corpus import (
    CALIBRATION_FLOORS,
    FIRST_YEAR,
    GROUPS,
    SCORE_FLOORS,
    STRICT_CLUSTERS,
    TEST_SHARE,
)

SEED = 12345
PRIME = 2147483647
STEP = 506952113
SPACE = r"\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANK = SPACE + r"\x{001c}-\x{001f}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items) -> str:
    return "(" + ", ".join(quoted(i) for i in items) + ")"


def array(items) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]"


def hash32(salt: str, id_: str = "id") -> str:
    return f"CAST('0x' || substr(md5('{SEED}|{salt}|' || {id_}), 1, 8) AS BIGINT)"


def u(salt: str, id_: str = "id") -> str:
    return f"({hash32(salt, id_)} / 4294967296::DOUBLE)"


def mixed(draw: str, pos: str) -> str:
    y = f"(({draw} + {pos} * {STEP}) % {PRIME})"
    power = y
    for _ in range(4):
        power = f"({power} * {y} % {PRIME})"
    return power


def choose(draw: str, weighted) -> str:
    total = sum(w for _, w in weighted)
    reached, cases = 0.0, ""
    for value, weight in weighted[:-1]:
        reached += weight
        cases += f" WHEN {draw} < {reached / total!r}::DOUBLE THEN {value}"
    return f"CASE{cases} ELSE {weighted[-1][0]} END" if cases else str(weighted[-1][0])


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# Base tables

POSTS = """
line_tags AS (
  SELECT l_orderkey AS id, lower(p_brand) AS brand,
         unnest([p_name, lower(p_type), 'flag ' || lower(l_returnflag),
                 'line ' || CAST(l_linenumber AS VARCHAR)]) AS tag
  FROM lineitem JOIN part ON l_partkey = p_partkey),
line_brands AS (
  SELECT l_orderkey AS id, lower(p_brand) AS brand
  FROM lineitem JOIN part ON l_partkey = p_partkey),
generals AS (SELECT id, string_agg(tag, ', ' ORDER BY tag) AS general FROM line_tags GROUP BY id),
brands AS (SELECT id, string_agg(brand, ', ' ORDER BY brand) AS copyright FROM line_brands
           GROUP BY id),
posts AS (
  SELECT o_orderkey AS id, general,
         CASE WHEN o_orderstatus <> 'P' THEN lower(c_name) END AS character, copyright,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'e' WHEN '2-HIGH' THEN 'q'
              WHEN '3-MEDIUM' THEN 's' ELSE 'g' END AS rating,
         CAST(floor(o_totalprice / 5000) AS INTEGER) AS score,
         CAST(o_orderkey * 37 % 1793 + 256 AS INTEGER) AS image_width,
         CAST(o_orderkey * 101 % 1793 + 256 AS INTEGER) AS image_height,
         strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00.000-05:00' AS created_at
  FROM orders LEFT JOIN generals ON o_orderkey = generals.id
              LEFT JOIN brands ON o_orderkey = brands.id
              LEFT JOIN customer ON o_custkey = c_custkey)"""

CLEAN = f"""
clean AS (
  SELECT id, general, coalesce(character, '') AS character, coalesce(copyright, '') AS copyright,
         rating, score, image_width, image_height, created_at
  FROM posts WHERE general IS NOT NULL AND regexp_matches(general, '[^{BLANK}]'))"""


def occurrences(field: str, table: str = "posts", id_: str = "id", text: str | None = None) -> str:
    text = text or field
    return (
        f"SELECT {id_} AS id, '{field}' AS field, o.tag, o.ord - 1 AS pos FROM {table}, "
        f"unnest(string_split({text}, ', ')) WITH ORDINALITY o(tag, ord) WHERE {text} IS NOT NULL"
    )


COUNTS = f"""
occurrences AS ({occurrences("general")} UNION ALL {occurrences("copyright")}
                UNION ALL {occurrences("character")}),
counts AS (SELECT field, tag, count(*) AS cnt, min(CAST(id AS HUGEINT) * 4294967296 + pos) AS first_seen
           FROM occurrences GROUP BY field, tag),
sizes AS (SELECT count(*) AS n_posts FROM posts),
popular AS (
  SELECT counts.* FROM counts, sizes
  WHERE (field = 'general' AND cnt * 100 >= 6 * n_posts)
     OR (field = 'copyright' AND cnt * 8 >= n_posts) OR (field = 'character' AND cnt >= 8))"""


def vocabulary(name: str, special: str, kinds) -> str:
    tokens = C.SPECIAL_TOKENS[special]
    rank = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(kinds))
    return f"""
{name} AS (
  SELECT CAST(s.ord - 1 AS INTEGER) AS token_id, s.token, 'special' AS kind,
         CAST(NULL AS BIGINT) AS cnt
  FROM unnest({array(tokens)}) WITH ORDINALITY s(token, ord)
  UNION ALL
  SELECT CAST({len(tokens) - 1} + row_number() OVER (
           ORDER BY CASE field {rank} END, cnt DESC, first_seen, tag) AS INTEGER),
         tag, field, cnt
  FROM popular WHERE field IN {listed(kinds)})"""


VOCAB = vocabulary("vocab", "main", ("general", "copyright", "character"))
ENCODE_VOCAB = vocabulary("encode_vocab", "encode", ("general", "character", "copyright"))
MASKED_VOCAB = vocabulary("masked_vocab", "masked", ("general",))


def pieces(name: str, table: str, text: str) -> str:
    """id, pos, tag, token_id (null if unknown); pos counts non-empty pieces from 0."""
    return f"""
{name} AS (
  SELECT p.id, p.pos, p.tag, vocab.token_id
  FROM (SELECT id, tag, row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS pos
        FROM {table}, unnest(string_split_regex(lower({text}), ',[{SPACE}]*'))
             WITH ORDINALITY o(tag, ord)
        WHERE tag <> '') p
  LEFT JOIN vocab ON p.tag = vocab.token)"""


def known(source: str = "clean") -> str:
    """Posts that pass the unknown-tag filters and caps, and their known general tags."""
    return f"""
{pieces("c_pieces", source, "copyright").strip()},
{pieces("h_pieces", source, "character").strip()},
{pieces("g_pieces", source, "general").strip()},
known AS (
  SELECT * FROM {source}
  WHERE id NOT IN (SELECT id FROM c_pieces WHERE token_id IS NULL)
    AND id NOT IN (SELECT id FROM h_pieces WHERE token_id IS NULL)
    AND len(string_split(copyright, ', ')) <= 5 AND len(string_split(character, ', ')) <= 10
    AND id NOT IN (SELECT id FROM g_pieces WHERE token_id IS NOT NULL GROUP BY id
                   HAVING count(*) > 100)),
tokens AS (
  SELECT g.id, g.pos, g.tag, g.token_id, {group_of("g.tag")} AS grp
  FROM g_pieces g JOIN known USING (id) WHERE g.token_id IS NOT NULL)"""


def group_of(tag: str) -> str:
    return (
        f"CASE WHEN {tag} IN {listed(GROUPS.people)} THEN 'people' "
        f"WHEN {tag} IN {listed(GROUPS.focus)} THEN 'focus' "
        f"WHEN {tag} IN {listed(GROUPS.watermark)} THEN 'watermark' "
        f"WHEN {tag} IN {listed(GROUPS.artistic_error)} THEN 'artistic_error' ELSE 'rest' END"
    )


BASE = (POSTS, CLEAN, COUNTS, VOCAB)

CLUSTERS = f"""
cluster_map AS (
  SELECT 'lax' AS level, token, cnt, label AS cluster_id
  FROM vocab JOIN embeddings ON token_id = vec_id
  UNION ALL
  SELECT 'strict', token, cnt, label % {STRICT_CLUSTERS}
  FROM vocab JOIN embeddings ON token_id = vec_id)"""

FINETUNE_LEVELS = (("'lax'", 0.6), ("'strict'", 0.4))
CALIBRATION_LEVELS = (("'lax'", 0.25), ("'strict'", 0.25), ("'none'", 0.5))
FINETUNE_RATES = ((0.75, 0.25), (0.5, 0.25), (0.25, 0.5))
DEFAULT_RATES = ((0.5, 1.0),)


def by_cluster(levels) -> str:
    """rest tags with the rank of their cluster (by first appearance) within the post."""
    return f"""
levels AS (SELECT id, {choose(u("identity"), levels)} AS level FROM known),
placed AS (
  SELECT t.id, t.pos, t.tag, t.token_id, l.level,
         CASE WHEN l.level = 'none' THEN -1 ELSE m.cluster_id END AS cluster_id,
         l.level <> 'none' AND m.cluster_id IS NULL AS lost
  FROM tokens t JOIN levels l USING (id)
  LEFT JOIN cluster_map m ON m.level = l.level AND m.token = t.tag
  WHERE t.grp = 'rest'),
seen AS (SELECT id, cluster_id, min(pos) AS first_pos FROM placed GROUP BY id, cluster_id),
cluster_order AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first_pos) AS cluster_rank
                  FROM seen),
others AS (
  SELECT p.id, p.pos, p.tag, p.token_id, o.cluster_rank
  FROM placed p JOIN cluster_order o
    ON p.id = o.id AND p.cluster_id IS NOT DISTINCT FROM o.cluster_id)"""


ONE_CLUSTER = """
others AS (SELECT id, pos, tag, token_id, 1 AS cluster_rank FROM tokens WHERE grp = 'rest')"""


def franchise() -> str:
    """Posts whose copyright has a tag other than the one for original works."""
    return """
franchise AS (
  SELECT id, bool_or(tag <> 'original') AS is_franchise
  FROM (SELECT id, unnest(string_split(copyright, ', ')) AS tag FROM known) GROUP BY id)"""


def keep_parts(rates, augment: bool) -> str:
    rate = choose(u("condition_rate"), rates)
    divisor = "(CASE WHEN is_franchise THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END)" if augment else (
        "1.0::DOUBLE"
    )
    return f"""
{franchise().strip()},
amounts AS (
  SELECT id, max(cluster_rank) AS n_clusters, count(*) AS n_rest FROM others GROUP BY id),
cuts AS (
  SELECT a.id, a.n_clusters,
         CAST(floor({u("split", "a.id")} * ceil(
           (CASE WHEN n_clusters = 1 THEN n_rest ELSE n_clusters END)
           * (CAST({rate.replace("|| id", "|| a.id")} AS DOUBLE) / {divisor}))) AS BIGINT) AS cut
  FROM amounts a JOIN franchise f USING (id)),
ranked_others AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rank_in_post FROM others),
sided AS (
  SELECT o.*, CASE WHEN c.n_clusters = 1 THEN o.rank_in_post <= c.cut
                   ELSE o.cluster_rank <= c.cut END AS in_condition
  FROM ranked_others o JOIN cuts c USING (id)),
condition AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, cluster_rank, pos) - 1 AS place
  FROM (SELECT id, pos, tag, token_id, 0 AS cluster_rank,
               CASE grp WHEN 'people' THEN 0 ELSE 1 END AS part
        FROM tokens WHERE grp IN ('people', 'focus') AND id IN (SELECT id FROM cuts)
        UNION ALL
        SELECT id, pos, tag, token_id, cluster_rank, 2 FROM sided WHERE in_condition)),
completion AS (
  SELECT id, pos, tag, token_id, cluster_rank FROM sided WHERE NOT in_condition)"""


def free_parts(rates) -> str:
    rate = choose(u("condition_rate"), rates).replace("|| id", "|| a.id")
    return f"""
{franchise().strip()},
amounts AS (SELECT id, count(*) AS n_rest FROM others GROUP BY id),
cuts AS (
  SELECT a.id,
         CAST(floor({u("split", "a.id")} * ceil(
           n_rest * CAST({rate} AS DOUBLE)
           / CASE WHEN is_franchise THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END)) AS BIGINT) AS cut,
         {u("drop_people", "a.id")} < 0.1::DOUBLE AS drop_people
  FROM amounts a JOIN franchise f USING (id)),
flat AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS place FROM others),
turned AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY {mixed(hash32("other"), "place")}) AS turn
  FROM flat),
condition AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, turn, pos) - 1 AS place
  FROM (SELECT t.id, t.pos, t.tag, t.token_id, t.turn, 0 AS part
        FROM turned t JOIN cuts USING (id) WHERE turn <= cut
        UNION ALL
        SELECT t.id, t.pos, t.tag, t.token_id, 0, CASE grp WHEN 'people' THEN 1 ELSE 2 END
        FROM tokens t JOIN cuts USING (id)
        WHERE grp IN ('people', 'focus') AND NOT drop_people)),
completion AS (
  SELECT t.id, t.pos, t.tag, t.token_id FROM turned t JOIN cuts USING (id) WHERE turn > cut
  UNION ALL
  SELECT t.id, t.pos, t.tag, t.token_id FROM tokens t JOIN cuts USING (id)
  WHERE grp IN ('people', 'focus') AND drop_people)"""


def named_texts(arranged: bool) -> str:
    """Copyright and character texts, shuffled or sorted."""
    out = []
    for name, table in (("copyright", "cp"), ("character", "ch")):
        order = mixed(hash32(f"{name}_tags"), "place") if arranged else "tag"
        out.append(
            f"{table}_tags AS (SELECT id, o.tag, o.ord - 1 AS place FROM known, "
            f"unnest(string_split({name}, ', ')) WITH ORDINALITY o(tag, ord)),\n"
            f"{table} AS (SELECT id, string_agg(tag, ', ' ORDER BY {order}) AS {name} "
            f"FROM {table}_tags GROUP BY id)"
        )
    return ",\n".join(out)


ARRANGED = f"""
pre AS (
  SELECT id, string_agg(tag, ', ' ORDER BY {mixed(hash32("condition"), "place")}) AS condition,
         string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY {mixed(hash32("condition"), "place")})
           AS condition_ids
  FROM condition GROUP BY id),
post AS (
  SELECT id, string_agg(tag, ', ' ORDER BY tag) AS completion,
         string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY tag) AS completion_ids
  FROM completion GROUP BY id)"""

PLAIN = """
post AS (
  SELECT id, string_agg(tag, ', ' ORDER BY tag) AS completion,
         string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY tag) AS completion_ids
  FROM tokens WHERE grp IN ('people', 'focus', 'rest') GROUP BY id)"""


def exact(rating: str = "rating") -> str:
    return f"CASE {rating} " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in C.EXACT_RATING.items()
    ) + " END"


def coarse(rating: str = "rating") -> str:
    return f"CASE {rating} " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in C.COARSE_RATING.items()
    ) + " END"


def fuzzy(rate: float, id_: str = "id") -> str:
    return f"CASE WHEN {u('fuzzy_rating', id_)} < {rate}::DOUBLE THEN {coarse()} ELSE {exact()} END"


ASPECT = """CASE
  WHEN image_width * 2 <= image_height THEN '<|aspect_ratio:ultra_tall|>'
  WHEN image_width * 9 <= image_height * 8 THEN '<|aspect_ratio:tall|>'
  WHEN image_width * 8 < image_height * 9 THEN '<|aspect_ratio:square|>'
  WHEN image_width < image_height * 2 THEN '<|aspect_ratio:wide|>'
  ELSE '<|aspect_ratio:ultra_wide|>' END"""


def length(n: str) -> str:
    return (
        f"CASE WHEN {n} < 10 THEN '<|length:very_short|>' WHEN {n} < 20 THEN '<|length:short|>' "
        f"WHEN {n} < 30 THEN '<|length:medium|>' WHEN {n} < 40 THEN '<|length:long|>' "
        f"ELSE '<|length:very_long|>' END"
    )


def common(rate: float) -> str:
    return f"""
shown AS (SELECT id, count(*) AS n_shown FROM tokens WHERE grp IN ('people', 'focus', 'rest')
          GROUP BY id),
common AS (
  SELECT id, {length("coalesce(n_shown, 0)")} AS length_token, {fuzzy(rate)} AS rating_token,
         {ASPECT} AS aspect_token
  FROM known LEFT JOIN shown USING (id))"""


def section_ids(table: str, text: str) -> str:
    """Ids of a section's text, the unknown id for unknown tags."""
    name = f"{table}_ids"
    unk = C.SPECIAL_TOKENS["main"].index(C.UNK)
    return f"""
{pieces(f"{table}_pieces", table, text).strip()},
{name} AS (SELECT id, string_agg(CAST(coalesce(token_id, {unk}) AS VARCHAR), ' ' ORDER BY pos) AS ids
           FROM {table}_pieces GROUP BY id)"""


def special_id(token: str) -> str:
    return str(C.SPECIAL_TOKENS["main"].index(token))


def id_of(column: str, among) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{t}' THEN '{special_id(t)}'" for t in among) + " END"


HEAD_TEXT = (
    f"'{C.BOS}{C.COPYRIGHT_START}' || cp.copyright || '{C.COPYRIGHT_END}{C.CHARACTER_START}' "
    f"|| ch.character || '{C.CHARACTER_END}' || rating_token || aspect_token || length_token "
    f"|| '{C.GENERAL_START}'"
)
HEAD_IDS = (
    f"'{special_id(C.BOS)}', '{special_id(C.COPYRIGHT_START)}', cp_ids.ids, "
    f"'{special_id(C.COPYRIGHT_END)}', '{special_id(C.CHARACTER_START)}', ch_ids.ids, "
    f"'{special_id(C.CHARACTER_END)}', {id_of('rating_token', C.RATING_TOKENS)}, "
    f"{id_of('aspect_token', C.ASPECT_RATIO_TOKENS)}, {id_of('length_token', C.LENGTH_TOKENS)}, "
    f"'{special_id(C.GENERAL_START)}'"
)
TAIL_IDS = f"'{special_id(C.GENERAL_END)}', '{special_id(C.EOS)}'"

PRETRAIN = (
    *BASE,
    known(),
    named_texts(False),
    common(0.25),
    PLAIN,
    section_ids("cp", "copyright"),
    section_ids("ch", "character"),
    f"""
prepared AS (
  SELECT known.id,
         {HEAD_TEXT} || coalesce(completion, '') || '{C.GENERAL_END}{C.EOS}' AS text,
         concat_ws(' ', {HEAD_IDS}, completion_ids, {TAIL_IDS}) AS input_ids
  FROM known JOIN common USING (id) JOIN cp USING (id) JOIN ch USING (id)
  LEFT JOIN post USING (id) LEFT JOIN cp_ids USING (id) LEFT JOIN ch_ids USING (id))""",
)


def floors(table) -> str:
    return " OR ".join(f"(rating = '{r}' AND score > {n})" for r, n in table)


def finetune(score_floors, first_year, levels, rates, fuzzy_rate) -> tuple[str, ...]:
    recent = f" AND CAST(substr(created_at, 1, 4) AS INTEGER) >= {first_year}" if first_year else ""
    identity = "CASE level " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in C.IDENTITY_TOKEN.items()
    ) + " END"
    return (
        *BASE,
        f"scored AS (SELECT * FROM clean WHERE ({floors(score_floors)}){recent})",
        known("scored"),
        CLUSTERS,
        by_cluster(levels),
        keep_parts(rates, True),
        ARRANGED,
        named_texts(True),
        common(fuzzy_rate),
        section_ids("cp", "copyright"),
        section_ids("ch", "character"),
        "lost AS (SELECT id, bool_or(lost) AS lost FROM placed GROUP BY id)",
        f"""
prepared AS (
  SELECT known.id,
         {HEAD_TEXT} || coalesce(condition, '') || {identity} || '{C.INPUT_END}' || completion
           || '{C.GENERAL_END}{C.EOS}' AS text,
         concat_ws(' ', {HEAD_IDS}, condition_ids, {id_of(identity, C.IDENTITY_TOKENS)},
                   '{special_id(C.INPUT_END)}', completion_ids, {TAIL_IDS}) AS input_ids
  FROM known JOIN common USING (id) JOIN cp USING (id) JOIN ch USING (id) JOIN levels USING (id)
  JOIN post USING (id) LEFT JOIN pre USING (id) JOIN lost USING (id)
  LEFT JOIN cp_ids USING (id) LEFT JOIN ch_ids USING (id)
  WHERE NOT lost.lost)""",
    )


SFT = finetune(SCORE_FLOORS, None, FINETUNE_LEVELS, FINETUNE_RATES, 0.3)
CALIBRATION = finetune(
    CALIBRATION_FLOORS, FIRST_YEAR, CALIBRATION_LEVELS, DEFAULT_RATES, 0.25
)


def split(table: str, columns: str) -> str:
    return f"""
SELECT {columns},
       CASE WHEN row_number() OVER (ORDER BY {hash32("split_rows")}, id)
                 <= (SELECT count(*) // {TEST_SHARE} FROM orders)
            THEN 'test' ELSE 'train' END AS split
FROM {table}"""


SCORES = """
ranked AS (
  SELECT rating, score, row_number() OVER (PARTITION BY rating ORDER BY score) - 1 AS rank,
         count(*) OVER (PARTITION BY rating) AS n FROM posts),
bounds AS (
  SELECT rating,
         max(score) FILTER (rank = CAST(floor(n * 0.1::DOUBLE) AS BIGINT)) AS b0,
         max(score) FILTER (rank = CAST(floor(n * 0.25::DOUBLE) AS BIGINT)) AS b1,
         max(score) FILTER (rank = CAST(floor(n * 0.75::DOUBLE) AS BIGINT)) AS b2,
         max(score) FILTER (rank = CAST(floor(n * 0.9::DOUBLE) AS BIGINT)) AS b3
  FROM ranked GROUP BY rating)"""


def histogram(values: str, low: int, high: int, bins: int, by: str | None, groups=()) -> str:
    spine = f"SELECT CAST(range AS INTEGER) AS bin FROM range({bins})"
    keys = ["bin"]
    if by:
        spine = f"SELECT g.{by}, CAST(range AS INTEGER) AS bin FROM range({bins}), unnest({array(groups)}) g({by})"
        keys = [by, "bin"]
    key = f"{by}, " if by else ""
    return f"""
spine AS ({spine}),
binned AS (
  SELECT {key}CAST(least((value - {low}) * {bins} // {high - low}, {bins - 1}) AS INTEGER) AS bin,
         count(*) AS n
  FROM ({values}) WHERE value BETWEEN {low} AND {high} GROUP BY ALL),
histogram AS (
  SELECT {", ".join(f"spine.{k}" for k in keys)}, coalesce(n, 0) AS n
  FROM spine LEFT JOIN binned USING ({", ".join(keys)}))"""


def sections() -> str:
    return f"""
parts AS (
  SELECT id, 0 AS part, '{C.BOS}' AS tag, 0 AS pos FROM clean
  UNION ALL SELECT id, 1, '{C.RATING_START}', 0 FROM clean
  UNION ALL SELECT id, 2, CASE WHEN rating IN ('q', 'e') THEN 'rating:nsfw' ELSE 'rating:sfw' END, 0
            FROM clean
  UNION ALL SELECT id, 3, '{C.RATING_END}', 0 FROM clean
  UNION ALL SELECT id, 4, '{C.COPYRIGHT_START}', 0 FROM clean
  UNION ALL SELECT id, 5, tag, pos FROM c_pieces
  UNION ALL SELECT id, 6, '{C.COPYRIGHT_END}', 0 FROM clean
  UNION ALL SELECT id, 7, '{C.CHARACTER_START}', 0 FROM clean
  UNION ALL SELECT id, 8, tag, pos FROM h_pieces
  UNION ALL SELECT id, 9, '{C.CHARACTER_END}', 0 FROM clean
  UNION ALL SELECT id, 10, '{C.GENERAL_START}', 0 FROM clean
  UNION ALL SELECT id, 11, tag, pos FROM g_pieces
  UNION ALL SELECT id, 12, '{C.GENERAL_END}', 0 FROM clean WHERE id % 20 <> 3),
whole AS (SELECT id, bool_or(part = 12) AS complete FROM parts GROUP BY id),
ordered AS (
  SELECT id, tag, pos, CASE WHEN part = 11 AND tag IN {listed(GROUPS.people)} THEN 0
                            WHEN part = 8 THEN 1 WHEN part = 5 THEN 2 WHEN part = 11 THEN 3
                            ELSE 4 END AS part
  FROM parts WHERE part IN (2, 5, 8, 11))"""


def cluster_parts() -> tuple[str, ...]:
    return (*BASE, known(), CLUSTERS, by_cluster(FINETUNE_LEVELS))


SEQUENCE = """
sequence AS (
  SELECT id, CAST(o.x AS INTEGER) AS x, o.ord - 1 AS i
  FROM prepared, unnest(string_split(input_ids, ' ')) WITH ORDINALITY o(x, ord))"""

CUT = f"""{SEQUENCE},
padded AS (
  SELECT ids.id, i.range AS i, coalesce(s.x, {special_id(C.PAD)}) AS x
  FROM (SELECT DISTINCT id FROM sequence) ids, range(32) i
  LEFT JOIN sequence s ON s.id = ids.id AND s.i = i.range)"""

PADDED = f"""{SEQUENCE},
padded AS (
  SELECT p.id, p.i, coalesce(s.x, {special_id(C.PAD)}) AS x
  FROM (SELECT id, unnest(range(n + 3)) AS i FROM (SELECT id, count(*) AS n FROM sequence GROUP BY id)) p
  LEFT JOIN sequence s ON s.id = p.id AND s.i = p.i),
ends AS (SELECT id, max(i) FILTER (x = {special_id(C.INPUT_END)}) AS end_at FROM padded GROUP BY id)"""


def oracle() -> dict[str, str]:
    documents = f"""
occurrences AS ({occurrences("general", "documents", "doc_id", "text")}),
counts AS (SELECT field, tag, count(*) AS cnt, min(CAST(id AS HUGEINT) * 4294967296 + pos) AS first_seen
           FROM occurrences GROUP BY field, tag)"""
    group_texts = ", ".join(
        f"coalesce(string_agg(tag, ', ' ORDER BY pos) FILTER (grp = '{g}'), '') AS {g}"
        for g in ("people", "focus", "watermark", "artistic_error", "rest")
    )
    sql = {
        "posts_clean": with_(POSTS, CLEAN, select="SELECT * FROM clean"),
        "text_only": with_(POSTS, CLEAN, select="SELECT id, general AS text FROM clean"),
        "head_sample": with_(POSTS, select="SELECT * FROM posts ORDER BY id LIMIT 1000"),
        "score_filter": with_(
            POSTS, select=f"SELECT id, rating, score FROM posts WHERE {floors(SCORE_FLOORS)}"
        ),
        "year_filter": with_(
            POSTS,
            select="SELECT id, CAST(substr(created_at, 1, 4) AS INTEGER) AS year FROM posts "
            f"WHERE CAST(substr(created_at, 1, 4) AS INTEGER) >= {FIRST_YEAR}",
        ),
        "size_caps": with_(
            POSTS,
            CLEAN,
            select="""
SELECT id, CAST(len(string_split(general, ', ')) AS INTEGER) AS n_general FROM clean
WHERE len(string_split(general, ', ')) <= 100 AND len(string_split(character, ', ')) <= 10
  AND len(string_split(copyright, ', ')) <= 5""",
        ),
        "tag_frequency": with_(POSTS, COUNTS, select="SELECT * FROM counts"),
        "popular_tags": with_(POSTS, COUNTS, select="SELECT field, tag, cnt FROM popular"),
        "vocab_build": with_(POSTS, COUNTS, VOCAB, select="SELECT * FROM vocab"),
        "vocab_build_encode": with_(
            POSTS, COUNTS, ENCODE_VOCAB, select="SELECT * FROM encode_vocab"
        ),
        "vocab_build_masked": with_(
            POSTS, COUNTS, MASKED_VOCAB, select="SELECT * FROM masked_vocab"
        ),
        "vocab_duplicates": with_(
            POSTS,
            COUNTS,
            VOCAB,
            MASKED_VOCAB,
            select="""
SELECT token, count(*) AS n, string_agg(kind, ', ' ORDER BY kind) AS kinds
FROM (SELECT token, kind FROM vocab UNION ALL SELECT token, kind FROM masked_vocab)
GROUP BY token HAVING count(*) > 1""",
        ),
        "vocab_sizes": with_(
            POSTS,
            COUNTS,
            VOCAB,
            select="SELECT kind, count(*) AS n FROM vocab GROUP BY kind "
            "UNION ALL SELECT 'total', count(*) FROM vocab",
        ),
        "document_frequency": with_(documents, select="SELECT * FROM counts"),
        "document_pieces": f"""
SELECT piece, count(*) AS n
FROM (SELECT unnest(string_split_regex(lower(text), ',[{SPACE}]*')) AS piece FROM documents)
WHERE piece <> '' GROUP BY piece""",
        "vocab_unreachable": with_(
            documents,
            select="SELECT tag AS token, cnt FROM counts "
            "WHERE cnt >= 2 AND (lower(tag) <> tag OR contains(tag, ',') OR tag = '')",
        ),
        "rating_counts": with_(
            POSTS, select="SELECT rating, count(*) AS n FROM posts GROUP BY rating"
        ),
        "tags_per_post": with_(
            POSTS,
            select="SELECT CAST(coalesce(len(string_split(general, ', ')), 0) AS INTEGER) AS n_tags, "
            "count(*) AS n_posts FROM posts GROUP BY 1",
        ),
        "length_histogram": with_(
            POSTS,
            histogram(
                "SELECT coalesce(len(string_split(general, ', ')), 0) AS value FROM posts",
                1, 150, 150, None,
            ),
            select="SELECT bin, n FROM histogram",
        ),
        "score_histogram": with_(
            POSTS,
            histogram(
                "SELECT rating, score AS value FROM posts", 0, 100, 50, "rating", "eqsg"
            ),
            select="SELECT rating, bin, bin * 2.0::DOUBLE AS left_edge, n FROM histogram",
        ),
        "count_histogram": with_(
            POSTS,
            COUNTS,
            histogram(
                "SELECT field, cnt AS value FROM counts", 1, 1000, 100, "field",
                ("general", "copyright", "character"),
            ),
            select="SELECT field, bin, n FROM histogram",
        ),
        "score_boxplot": with_(
            POSTS,
            """
box AS (
  SELECT rating, count(*) AS n, quantile_cont(CAST(score AS DOUBLE), 0.25) AS q1,
         quantile_cont(CAST(score AS DOUBLE), 0.5) AS median,
         quantile_cont(CAST(score AS DOUBLE), 0.75) AS q3
  FROM posts GROUP BY rating)""",
            select="""
SELECT rating, any_value(n) AS n, any_value(q1) AS q1, any_value(median) AS median,
       any_value(q3) AS q3,
       least(coalesce(min(CAST(score AS DOUBLE)) FILTER (score >= q1 - (q3 - q1) * 1.5),
                      any_value(q1)), any_value(q1)) AS whisker_low,
       greatest(coalesce(max(CAST(score AS DOUBLE)) FILTER (score <= q3 + (q3 - q1) * 1.5),
                         any_value(q3)), any_value(q3)) AS whisker_high,
       count(*) FILTER (score < q1 - (q3 - q1) * 1.5 OR score > q3 + (q3 - q1) * 1.5) AS outliers
FROM posts JOIN box USING (rating) GROUP BY rating""",
        ),
        "boundary_scores": with_(POSTS, SCORES, select="SELECT * FROM bounds"),
        "quality_bands": with_(
            POSTS,
            SCORES,
            """
banded AS (
  SELECT rating, CASE WHEN score <= b0 THEN 0 WHEN score <= b1 THEN 1 WHEN score <= b2 THEN 2
                      WHEN score <= b3 THEN 3 ELSE 4 END AS band, count(*) AS n
  FROM posts JOIN bounds USING (rating) GROUP BY ALL)""",
            select="""
SELECT s.rating, s.band, coalesce(n, 0) AS n
FROM (SELECT rating, CAST(range AS INTEGER) AS band FROM bounds, range(5)) s
LEFT JOIN banded USING (rating, band)""",
        ),
        "aspect_ratio_tags": with_(POSTS, select=f"SELECT id, {ASPECT} AS aspect_token FROM posts"),
        "length_tags": with_(
            POSTS,
            select=f"SELECT id, CAST(n AS INTEGER) AS n_tags, {length('n')} AS length_token FROM "
            "(SELECT id, coalesce(len(string_split(general, ', ')), 0) AS n FROM posts)",
        ),
        "rating_tags": with_(
            POSTS,
            select=f"SELECT id, {exact()} AS exact, {coarse()} AS coarse, {fuzzy(0.25)} AS fuzzy "
            "FROM posts",
        ),
        "unknown_reject": with_(
            *BASE,
            pieces("c_pieces", "clean", "copyright"),
            pieces("h_pieces", "clean", "character"),
            select="""
SELECT id, copyright, character FROM clean
WHERE id NOT IN (SELECT id FROM c_pieces WHERE token_id IS NULL)
  AND id NOT IN (SELECT id FROM h_pieces WHERE token_id IS NULL)""",
        ),
        "unknown_tag_report": with_(
            *BASE,
            *[
                pieces(f"{f}_pieces", "posts", f)
                for f in ("general", "copyright", "character")
            ],
            select=" UNION ALL ".join(
                f"SELECT '{f}' AS field, tag, count(DISTINCT id) AS n_posts FROM {f}_pieces "
                "WHERE token_id IS NULL GROUP BY tag"
                for f in ("general", "copyright", "character")
            ),
        ),
        "drop_unknown": with_(
            *BASE,
            pieces("g_pieces", "clean", "general"),
            select="""
SELECT clean.id, CAST(count(token_id) AS INTEGER) AS n,
       coalesce(string_agg(tag, ', ' ORDER BY pos) FILTER (token_id IS NOT NULL), '') AS tags
FROM clean LEFT JOIN g_pieces USING (id) GROUP BY clean.id""",
        ),
        "encode_tags": with_(
            *BASE,
            pieces("g_pieces", "clean", "general"),
            select=f"""
SELECT id, string_agg(CAST(coalesce(token_id, {special_id(C.UNK)}) AS VARCHAR), ' ' ORDER BY pos)
       AS token_ids
FROM g_pieces GROUP BY id""",
        ),
        "detokenize": with_(
            *PRETRAIN,
            """
ids AS (SELECT id, CAST(o.x AS INTEGER) AS token_id, o.ord AS pos
        FROM prepared, unnest(string_split(input_ids, ' ')) WITH ORDINALITY o(x, ord))""",
            select="""
SELECT ids.id, coalesce(string_agg(token, ', ' ORDER BY pos), '') AS text
FROM ids LEFT JOIN vocab ON vocab.token_id = ids.token_id AND kind <> 'special' GROUP BY ids.id""",
        ),
        "organize_group": with_(
            POSTS,
            CLEAN,
            f"occurrences AS ({occurrences('general', 'clean')})",
            select=f"""
SELECT id, {group_texts} FROM (SELECT *, {group_of("tag")} AS grp FROM occurrences) GROUP BY id""",
        ),
        "organize_cluster": with_(
            *cluster_parts(),
            """
lists AS (SELECT id, cluster_rank, string_agg(tag, ', ' ORDER BY pos) AS tags
          FROM others GROUP BY ALL),
lost AS (SELECT id, bool_or(lost) AS unclustered FROM placed GROUP BY id)""",
            select="""
SELECT id, level, coalesce(any_value(unclustered), false) AS unclustered,
       CAST(count(cluster_rank) AS INTEGER) AS n_clusters,
       coalesce(string_agg(tags, ' | ' ORDER BY cluster_rank), '') AS other
FROM levels LEFT JOIN lists USING (id) LEFT JOIN lost USING (id) GROUP BY id, level""",
        ),
        "common_tags": with_(
            *BASE, known(), common(0.25),
            select="SELECT id, length_token, rating_token, aspect_token FROM common",
        ),
        "identity_levels": with_(
            POSTS,
            select=f"SELECT id, {choose(u('identity'), FINETUNE_LEVELS)} AS finetune, "
            f"{choose(u('identity'), CALIBRATION_LEVELS)} AS calibration FROM posts",
        ),
        "condition_rates": with_(
            POSTS,
            select=f"SELECT id, CAST({choose(u('condition_rate'), FINETUNE_RATES)} AS DOUBLE) "
            "AS rate FROM posts",
        ),
        "recompose": with_(
            *cluster_parts(),
            keep_parts(FINETUNE_RATES, False),
            """
pre AS (SELECT id, string_agg(tag, ', ' ORDER BY place) AS condition FROM condition GROUP BY id),
post AS (SELECT id, string_agg(tag, ', ' ORDER BY cluster_rank, pos) AS completion
         FROM completion GROUP BY id)""",
            select="SELECT id, coalesce(condition, '') AS condition, completion "
            "FROM post LEFT JOIN pre USING (id)",
        ),
    }
    parts_select = (
        "SELECT id, coalesce(condition, '') AS condition, completion, copyright, character "
        "FROM post LEFT JOIN pre USING (id) JOIN cp USING (id) JOIN ch USING (id)"
    )
    component_select = (
        "SELECT id, copyright, character, coalesce(condition, '') AS condition, completion, "
        "rating_token, aspect_token, length_token "
        "FROM post LEFT JOIN pre USING (id) JOIN cp USING (id) JOIN ch USING (id) "
        "JOIN common USING (id)"
    )
    keep = (*cluster_parts(), keep_parts(FINETUNE_RATES, True), ARRANGED, named_texts(True))
    free = (
        *BASE, known(), ONE_CLUSTER, free_parts(FINETUNE_RATES), ARRANGED, named_texts(True)
    )
    sql |= {
        "condition_keep": with_(*keep, select=parts_select),
        "condition_free": with_(*free, select=parts_select),
        "components_plain": with_(
            *BASE, known(), named_texts(False), common(0.25), PLAIN,
            select="SELECT known.id, cp.copyright, ch.character, '' AS condition, "
            "coalesce(completion, '') AS completion, rating_token, aspect_token, length_token "
            "FROM known JOIN cp USING (id) JOIN ch USING (id) JOIN common USING (id) "
            "LEFT JOIN post USING (id)",
        ),
        "components_keep": with_(*keep, common(0.3), select=component_select),
        "components_free": with_(*free, common(0.3), select=component_select),
        "prompt_pretrain": with_(*PRETRAIN, select="SELECT id, text FROM prepared"),
        "prompt_sft": with_(*SFT, select="SELECT id, text FROM prepared"),
        "quarantine_sft": with_(
            *SFT,
            select="SELECT known.id, CASE WHEN lost.lost THEN 'unclustered_tag' "
            "ELSE 'no_tags_to_complete' END AS reason "
            "FROM known LEFT JOIN lost USING (id) "
            "WHERE known.id NOT IN (SELECT id FROM prepared)",
        ),
        "prompt_inference": with_(
            POSTS,
            CLEAN,
            select=f"""
SELECT id, '{C.BOS}{C.COPYRIGHT_START}' || trim(copyright) || '{C.COPYRIGHT_END}{C.CHARACTER_START}'
       || trim(character) || '{C.CHARACTER_END}' || {exact()} || {ASPECT}
       || {length("len(string_split(general, ', '))")} || '{C.GENERAL_START}' || trim(general)
       || CASE WHEN id % 2 = 0 THEN '' ELSE '{C.IDENTITY_NONE}{C.INPUT_END}' END AS prompt
FROM clean""",
        ),
        "prompt_sections": with_(
            *BASE,
            pieces("c_pieces", "clean", "copyright"),
            pieces("h_pieces", "clean", "character"),
            pieces("g_pieces", "clean", "general"),
            sections(),
            select="""
SELECT id, CASE WHEN any_value(complete) THEN
         replace(string_agg(tag, ', ' ORDER BY part, pos), 'rating:nsfw', 'nsfw') END AS text,
       NOT any_value(complete) AS cut_short
FROM ordered JOIN whole USING (id) GROUP BY id""",
        ),
        "pretrain_set": with_(*PRETRAIN, select=split("prepared", "id, text, input_ids")),
        "sft_set": with_(*SFT, select=split("prepared", "id, text, input_ids")),
        "calib_set": with_(*CALIBRATION, select=split("prepared", "id, text, input_ids")),
        "vector_training_set": with_(
            *BASE,
            pieces("g_pieces", "clean", "general"),
            """
kept AS (SELECT id, token_id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS place
         FROM g_pieces WHERE token_id IS NOT NULL)""",
            f"""
shuffled AS (
  SELECT id, string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY {mixed(hash32("ids"), "place")})
         AS input_ids
  FROM kept GROUP BY id HAVING count(*) > 10)""",
            select=split("shuffled", "id, input_ids"),
        ),
        "test_split": with_(POSTS, select=split("posts", "id")),
        "cosine_topk": with_(
            POSTS,
            COUNTS,
            VOCAB,
            """
vectors AS (SELECT token_id, token, CAST(embedding AS DOUBLE[]) AS v
            FROM vocab JOIN embeddings ON token_id = vec_id),
similarities AS (
  SELECT q.token AS query, t.token_id, t.token,
         round(list_cosine_similarity(q.v, t.v), 9) AS similarity
  FROM vectors q, vectors t WHERE q.token_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, token_id) AS rank
  FROM similarities)""",
            select="SELECT query, CAST(rank AS INTEGER) AS rank, token, "
            "round(similarity, 6) AS similarity FROM ranked WHERE rank <= 30 "
            "UNION ALL SELECT token, NULL, NULL, NULL FROM vocab "
            "WHERE token_id % 20 = 0 AND token_id NOT IN (SELECT vec_id FROM embeddings)",
        ),
        "vector_lookup": with_(
            *BASE,
            pieces("g_pieces", "clean", "general"),
            f"""
ids AS (SELECT id, pos, coalesce(token_id, {special_id(C.UNK)}) AS token_id FROM g_pieces),
digests AS (
  SELECT vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i:
           i * CAST(floor(CAST(embedding[i] AS DOUBLE) * 10000 + 0.5) AS BIGINT))) AS BIGINT) AS digest
  FROM embeddings)""",
            select="""
SELECT id, string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY pos) AS ids,
       string_agg(coalesce(CAST(digest AS VARCHAR), '-'), ' ' ORDER BY pos) AS digests
FROM ids LEFT JOIN digests ON token_id = vec_id GROUP BY id""",
        ),
        "cluster_members": with_(
            POSTS,
            COUNTS,
            VOCAB,
            CLUSTERS,
            select="SELECT cluster_id, count(*) AS n, string_agg(token, ', ' ORDER BY token) AS tags "
            "FROM cluster_map WHERE level = 'lax' GROUP BY cluster_id",
        ),
        "same_cluster": with_(
            POSTS,
            COUNTS,
            VOCAB,
            CLUSTERS,
            """
strict AS (SELECT * FROM cluster_map WHERE level = 'strict'),
leaders AS (
  SELECT token, cluster_id FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cnt DESC, token DESC) AS r
    FROM strict WHERE cnt IS NOT NULL) WHERE r = 1)""",
            select="SELECT leaders.token, cluster_id, strict.token AS member "
            "FROM leaders JOIN strict USING (cluster_id)",
        ),
        "embedding_transfer": with_(
            POSTS,
            COUNTS,
            VOCAB,
            ENCODE_VOCAB,
            f"""
old AS (SELECT token, embedding FROM vocab JOIN embeddings ON token_id = vec_id),
cells AS (
  SELECT e.token_id, e.token, i.range AS i, old.embedding[i.range + 1] AS kept,
         md5('{SEED}|init|' || e.token || '|' || i.range) AS digest
  FROM encode_vocab e CROSS JOIN range(64) i LEFT JOIN old ON old.token = e.token),
drawn AS (
  SELECT *, CAST(0.02::DOUBLE
             * (sqrt(-2.0::DOUBLE * ln((CAST('0x' || substr(digest, 1, 8) AS BIGINT) + 1)
                                       / 4294967296::DOUBLE))
             * cos(6.283185307179586::DOUBLE * ((CAST('0x' || substr(digest, 9, 8) AS BIGINT) + 1)
                                                / 4294967296::DOUBLE))) AS FLOAT) AS fresh
  FROM cells)""",
            select="""
SELECT token_id, token, bool_or(kept IS NOT NULL) AS copied,
       string_agg(CAST(CAST(round(CAST(coalesce(kept, fresh) AS DOUBLE), 4) AS DECIMAL(10, 4))
                       AS VARCHAR), ' ' ORDER BY i) AS embedding
FROM drawn GROUP BY token_id, token""",
        ),
        "vector_tsv": with_(
            POSTS,
            COUNTS,
            VOCAB,
            select="""
SELECT token_id, token AS label, array_to_string(list_transform(embedding, lambda x:
         CAST(CAST(round(CAST(x AS DOUBLE), 5) AS DECIMAL(10, 5)) AS VARCHAR)), chr(9)) AS vector
FROM vocab LEFT JOIN embeddings ON token_id = vec_id""",
        ),
        "pad_truncate": with_(
            *SFT,
            CUT,
            select="SELECT id, string_agg(CAST(x AS VARCHAR), ' ' ORDER BY i) AS ids "
            "FROM padded GROUP BY id",
        ),
        "causal_labels": with_(
            *SFT,
            PADDED,
            select=f"""
SELECT id, string_agg(CASE WHEN x = {special_id(C.PAD)} THEN '-100' ELSE CAST(x AS VARCHAR) END,
                      ' ' ORDER BY i) AS labels
FROM padded GROUP BY id""",
        ),
        "completion_labels": with_(
            *SFT,
            PADDED,
            select=f"""
SELECT id, string_agg(CASE WHEN x = {special_id(C.PAD)} OR end_at IS NULL OR i <= end_at THEN '-100'
                           ELSE CAST(x AS VARCHAR) END, ' ' ORDER BY i) AS labels
FROM padded JOIN ends USING (id) GROUP BY id""",
        ),
        "mlm_labels": with_(
            *BASE,
            pieces("g_pieces", "clean", "general"),
            f"""
ids AS (SELECT id, pos, coalesce(token_id, {special_id(C.UNK)}) AS x,
               {mixed(hash32("mask"), "pos")} / {PRIME}::DOUBLE AS draw
        FROM g_pieces),
chosen AS (
  SELECT *, draw < 0.15::DOUBLE AND x >= {len(C.SPECIAL_TOKENS["main"])} AS hit,
         draw / 0.15::DOUBLE AS how
  FROM ids),
size AS (SELECT count(*) AS n FROM vocab)""",
            select=f"""
SELECT id,
       string_agg(CAST(CASE WHEN NOT hit THEN x WHEN how < 0.8::DOUBLE THEN {special_id(C.MASK)}
         WHEN how < 0.9::DOUBLE
           THEN least(CAST(floor((how - 0.8::DOUBLE) / 0.1::DOUBLE * n) AS BIGINT), n - 1)
         ELSE x END AS VARCHAR), ' ' ORDER BY pos) AS input_ids,
       string_agg(CASE WHEN hit THEN CAST(x AS VARCHAR) ELSE '-100' END, ' ' ORDER BY pos) AS labels
FROM chosen, size GROUP BY id""",
        ),
    }
    vectors = with_(POSTS, COUNTS, VOCAB, select="SELECT token{} FROM vocab JOIN embeddings ON token_id = vec_id")
    names = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(GROUP_FILES))
    sql |= {
        "kmeans_map": vectors.format(", true AS in_range, true AS nearest, true AS cheapest"),
        "get_or_train": vectors.format(", true AS same, 1 AS trainings"),
        "revision_read": with_(POSTS, select="SELECT * FROM posts"),
        "split_read": with_(POSTS, select=split("posts", "id, general, score")),
        "tag_group_files": with_(
            POSTS,
            COUNTS,
            VOCAB,
            select=f"SELECT CASE token_id % {len(GROUP_FILES)} {names} END AS group_name, token AS tag "
            "FROM vocab WHERE kind = 'general'",
        ),
        "cluster_map_files": with_(
            POSTS,
            COUNTS,
            VOCAB,
            CLUSTERS,
            select="SELECT token, cluster_id FROM cluster_map WHERE level = 'lax'",
        ),
        "json_object_files": with_(
            POSTS, COUNTS, select="SELECT tag, cnt FROM counts WHERE field = 'general'"
        ),
        "reason_counts": with_(
            *SFT,
            f"""
failed AS (SELECT CASE WHEN lost.lost THEN 'unclustered_tag' ELSE 'no_tags_to_complete' END AS reason
           FROM known LEFT JOIN lost USING (id) WHERE known.id NOT IN (SELECT id FROM prepared))""",
            select=f"""
SELECT r AS reason, (SELECT count(*) FROM failed WHERE reason = r) AS n
FROM (SELECT unnest({array(REASONS)}) AS r)
UNION ALL SELECT 'accepted', count(*) FROM prepared""",
        ),
    }
    for name in ("encode_tags", "sft_set"):
        sql[f"{name}_joined"] = sql[name]
    sql["cosine_topk_pruned"] = sql["cosine_topk"]
    sql["merged_tag_counts"] = sql["tag_frequency"]
    for name in ("quality_bands", "tags_per_post"):
        sql[f"merged_{name}"] = sql[name]
    return sql
