"""DuckDB SQL with the results of the queries in ``gleaner.plans.queries``."""

from __future__ import annotations

from gleaner.functions import tags, text
from gleaner.operators import model
from gleaner.operators.features import kernel


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _attribute(name: str) -> str:
    pattern = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return " || ".join(f"regexp_extract(token, '{pattern}', {i})" for i in (1, 2, 3))


def _unescape(column: str) -> str:
    for name, character in text.ENTITIES:
        short = "?" if name[1:-1] in text.SHORT else ""
        column = f"regexp_replace({column}, '{name}{short}', '{character.replace(chr(39), chr(39) * 2)}', 'g')"
    return column


def _squeeze(column: str) -> str:
    return rf"trim(regexp_replace(coalesce({column}, ''), '[ \t\n\r\f\v]+', ' ', 'g'))"


EVENTS = rf"""
cleaned AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
    '(<script[^>]*>).*?</script\s*>', '\1</script>', 'gis'), '(<style[^>]*>).*?</style\s*>', '\1</style>', 'gis') AS h FROM pages
), tokens AS (
  SELECT page_id, unnest(list) AS token, generate_subscripts(list, 1) - 1 AS pos
  FROM (SELECT page_id, regexp_extract_all(h, '(<[^>]*>|[^<]+)', 1) AS list FROM cleaned)
), tagged AS (
  SELECT *, lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9:-]*)', 1)) AS tag,
    CASE WHEN token[1] <> '<' THEN 'text' WHEN token[1:2] = '</' THEN 'close' ELSE 'open' END AS kind FROM tokens
), events AS (
  SELECT page_id, pos::INT AS pos, kind, tag,
    CASE WHEN kind = 'open' THEN {_attribute("id")} ELSE '' END AS attr_id,
    CASE WHEN kind = 'open' THEN {_attribute("class")} ELSE '' END AS attr_class,
    CASE WHEN kind = 'open' AND tag = 'a' THEN {_attribute("href")} ELSE '' END AS href,
    CASE WHEN kind = 'text' THEN {_unescape("token")} ELSE '' END AS text
  FROM tagged WHERE kind = 'text' OR tag <> ''
)"""

_HOLDS = f"tag NOT IN {_in(tags.VOID)}"
RAW = f"""{EVENTS}, step1 AS (
  SELECT *, CASE WHEN tag IN {_in(tags.IGNORED)} AND {_HOLDS} THEN CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END ELSE 0 END AS s FROM events
), step2 AS (
  SELECT * EXCLUDE (s), sum(s) OVER w - greatest(s, 0) > 0 AS ignored FROM step1 WINDOW w AS (PARTITION BY page_id ORDER BY pos)
), step3 AS (
  SELECT *, CASE WHEN tag = 'a' AND NOT ignored THEN CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END ELSE 0 END AS s FROM step2
), step4 AS (
  SELECT * EXCLUDE (s), sum(s) OVER w - greatest(s, 0) > 0 AS anchored FROM step3 WINDOW w AS (PARTITION BY page_id ORDER BY pos)
), step5 AS (
  SELECT *, kind = 'open' AND tag IN {_in(tags.BLOCK_STARTS)} AND NOT ignored AND NOT anchored AS starts,
    kind = 'open' AND NOT ignored AND tag <> 'html' AS counted, kind = 'text' AND NOT ignored AS is_read FROM step4
), placed AS (
  SELECT *, counted AND NOT anchored AND tag NOT IN {_in(tags.IGNORED)} AS styled,
    sum(starts::INT) OVER (PARTITION BY page_id ORDER BY pos) AS raw_block FROM step5
), raw AS (
  SELECT page_id, raw_block::BIGINT AS raw_block, coalesce(max(tag) FILTER (WHERE starts), '') AS start_tag,
    {_squeeze("string_agg(text, ' ' ORDER BY pos) FILTER (WHERE is_read)")} AS text,
    {_squeeze("string_agg(text, ' ' ORDER BY pos) FILTER (WHERE is_read AND anchored)")} AS link_text,
    lower({_squeeze("string_agg(attr_id, ' ' ORDER BY pos) FILTER (WHERE styled AND attr_id <> '')")}) AS css_id,
    lower({_squeeze("string_agg(attr_class, ' ' ORDER BY pos) FILTER (WHERE styled AND attr_class <> '')")}) AS css_class,
    (count(*) FILTER (WHERE counted AND NOT starts))::INT AS n_tags,
    (count(*) FILTER (WHERE counted AND tag = 'a'))::INT AS n_anchors
  FROM placed GROUP BY page_id, raw_block
)"""

_BYTES = r"regexp_replace(regexp_replace(regexp_replace(text, '[\x{80}-\x{7FF}]', '  ', 'g'), '[\x{800}-\x{FFFF}]', '   ', 'g'), '[\x{10000}-\x{10FFFF}]', '    ', 'g')"
BLOCKS = rf"""{RAW}, runs AS (
  SELECT *, (text <> '')::INT AS filled, max(raw_block) OVER (PARTITION BY page_id) AS last,
    coalesce(sum((text <> '')::INT) OVER (PARTITION BY page_id ORDER BY raw_block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM raw
), counts AS (
  SELECT *, (n_tags + CASE WHEN raw_block = last THEN 0 ELSE 1 END)::INT AS tagcount,
    (sum(CASE WHEN filled = 0 THEN n_tags + 1 ELSE 0 END) OVER (PARTITION BY page_id, run))::INT AS tagcount_since_last_block FROM runs
), kept AS (SELECT * FROM counts WHERE filled = 1 AND regexp_matches(text, '[\pL\pN]')),
sized AS (
  SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY raw_block) - 1)::INT AS block_idx,
    strlen(text)::INT AS n_bytes, ceil(strlen(text) / 80.0)::INT AS n_lines, {_BYTES} AS plain FROM kept
), blocks AS (
  SELECT *, len(regexp_split_to_array(link_text, '[\W_]+'))::DOUBLE / len(regexp_split_to_array(text, '[\W_]+')) AS link_density,
    CASE WHEN n_lines <= 1 THEN len(regexp_split_to_array(text, '[\W_]+'))::DOUBLE
      ELSE len(regexp_split_to_array(substr(plain, 1, (n_lines - 1) * 80), '[\W_]+')) / (n_lines - 1.0)::DOUBLE END AS text_density
  FROM sized
)"""

_KERNEL = ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in kernel(1.0))
_SMOOTH = """, ratios AS (
  SELECT page_id, block_idx, n_bytes / greatest(tagcount, 1)::DOUBLE AS ctr, count(*) OVER (PARTITION BY page_id) AS n FROM blocks
), changes AS (
  SELECT *, abs(coalesce(avg(ctr) OVER (PARTITION BY page_id ORDER BY block_idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING),
    0.5 * (ctr + lag(ctr) OVER (PARTITION BY page_id ORDER BY block_idx)), ctr) - ctr) AS change FROM ratios
), kernel(o, w) AS (VALUES """ + _KERNEL + """),
places AS (
  SELECT page_id, block_idx, n, w, ((block_idx + o) % (2 * n) + 2 * n) % (2 * n) AS m FROM changes, kernel
), smooth AS (
  SELECT p.page_id, p.block_idx, sum(p.w * c.ctr) AS w_smooth, sum(p.w * c.change) AS w_absdiff
  FROM places p JOIN changes c ON c.page_id = p.page_id AND c.block_idx = CASE WHEN p.m < p.n THEN p.m ELSE 2 * p.n - 1 - p.m END
  GROUP BY p.page_id, p.block_idx
)"""
SMOOTH = BLOCKS + _SMOOTH

def _rank(column: str) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{t}' THEN {r}" for t, r in tags.RANK.items())} ELSE 100 END"


def _ends() -> str:
    """tag, tops: the innermost open elements that a start tag ends."""
    every = {t: {*tags.ENDS.get(t, ())} | ({"p", "head"} if t in tags.BLOCK_LEVEL else set()) for t in {*tags.BLOCK_LEVEL, *tags.ENDS}}
    return ", ".join(f"('{t}', [{', '.join(f"'{x}'" for x in sorted(tops))}])" for t, tops in sorted(every.items()))


_POINTS = f"CASE {' '.join(f"WHEN tag = '{t}' THEN {w}" for t, w in tags.TAG_WEIGHTS.items())} ELSE 0 END" + "".join(
    f" + CASE WHEN regexp_matches({c}, '(?i){tags.GOOD_WORDS}') THEN 25 ELSE 0 END - CASE WHEN regexp_matches({c}, '(?i){tags.BAD_WORDS}') THEN 25 ELSE 0 END" for c in ("attr_id", "attr_class")
)
#: A stack of open elements, tag by tag: for complete pages that have html, head and body.
DOM = f"""{BLOCKS}, ends(tag, tops) AS (VALUES {_ends()}),
steps AS MATERIALIZED (
  SELECT page_id, pos, kind, tag, {_POINTS} AS points, tag IN {_in(tags.IGNORED)} AS ignored_tag, tag IN {_in(tags.VOID)} AS void, tag IN {_in(tags.BLOCK_STARTS)} AS starter,
    coalesce(tops, []) AS tops, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i
  FROM events LEFT JOIN ends USING (tag) WHERE kind <> 'text' AND NOT (kind = 'close' AND tag IN ('html', 'body'))
), walk(page_id, i, pos, stack, num, kid, inside, counter, raw_block, closed, opened, number, above, entered, tagged, started, points) AS (
  SELECT DISTINCT page_id, 0::BIGINT, -1::INT, []::VARCHAR[], []::BIGINT[], []::BOOLEAN[], 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[], FALSE, FALSE, FALSE, 0 FROM steps
  UNION ALL
  SELECT page_id, i, pos,
    -- what stays open after this tag
    CASE WHEN kind = 'open' AND NOT void THEN list_append(kept, tag) ELSE kept END,
    CASE WHEN kind = 'open' AND NOT void THEN list_append(num[1:len(kept)], CASE WHEN enters THEN fresh END) ELSE num[1:len(kept)] END,
    CASE WHEN kind = 'open' AND NOT void THEN list_append(kids, FALSE) ELSE kids END,
    CASE WHEN kind = 'open' AND NOT void AND within = 0 AND (ignored_tag OR tag = 'a') THEN len(kept) + 1 ELSE within END,
    CASE WHEN kind = 'open' AND within = 0 AND len(kept) > 0 THEN fresh ELSE counter END,
    CASE WHEN started THEN raw_block + 1 ELSE raw_block END,
    CASE WHEN len(kept) < len(stack) AND (inside = 0 OR within = 0) AND depth < depth_before THEN depth END,
    CASE WHEN kind = 'open' AND enters THEN depth + 1 END,
    CASE WHEN kind = 'open' AND enters THEN fresh END,
    CASE WHEN started THEN num[1:len(kept)] END,
    kind = 'open' AND enters,
    kind = 'open' AND len(kept) > 0 AND NOT starter AND (within = 0 OR stack[within] = 'a'),
    started, points
  FROM (
    SELECT *, CASE WHEN within = 0 THEN len(kept) ELSE within - 1 END AS depth, CASE WHEN inside = 0 THEN len(stack) ELSE inside - 1 END AS depth_before,
      within = 0 AND NOT ignored_tag AND tag <> 'a' AS enters,
      kind = 'open' AND starter AND within = 0 AS started,
      CASE WHEN len(kept) = 0 THEN 0 ELSE counter + 1 + CASE WHEN kid[len(kept)] THEN 0 ELSE 1 END END AS fresh,
      CASE WHEN kind = 'open' AND within = 0 AND len(kept) > 0 THEN list_append(kid[1:len(kept) - 1], TRUE) ELSE kid[1:len(kept)] END AS kids
    FROM (
      SELECT *, CASE WHEN inside > len(kept) THEN 0 ELSE inside END AS within FROM (
        SELECT w.page_id, s.i, s.pos, s.kind, s.tag, s.void, s.ignored_tag, s.starter, s.points, w.stack, w.num, w.kid, w.inside, w.counter, w.raw_block,
          CASE WHEN s.kind = 'open' THEN
            w.stack[1:len(w.stack) - coalesce(list_position(list_transform(list_reverse(w.stack), lambda x: list_contains(s.tops, x)), FALSE) - 1, len(w.stack))]
          ELSE
            CASE WHEN NOT list_contains(w.stack, s.tag) THEN w.stack
              WHEN list_max(list_transform(w.stack[len(w.stack) - list_position(list_reverse(w.stack), s.tag) + 2:], lambda x: {_rank('x')})) > {_rank('s.tag')} THEN w.stack
              ELSE w.stack[1:len(w.stack) - list_position(list_reverse(w.stack), s.tag)] END
          END AS kept
        FROM walk w JOIN steps s ON s.page_id = w.page_id AND s.i = w.i + 1
      )
    )
  )
), levels AS (
  -- closings before a block start belong to the block before it
  SELECT page_id, raw_block - started::INT AS raw_block, pos, 0 AS half, closed AS level, NULL AS tagged_at FROM walk WHERE closed IS NOT NULL
  UNION ALL SELECT page_id, raw_block, pos, 2, opened, NULL FROM walk WHERE opened IS NOT NULL
  UNION ALL SELECT page_id, raw_block, pos, 1, NULL, pos FROM walk WHERE tagged
  -- a void element opens and closes
  UNION ALL SELECT page_id, raw_block, pos, 3, opened - 1, NULL FROM walk JOIN steps USING (page_id, i, pos) WHERE opened IS NOT NULL AND void
), turns AS (SELECT page_id, raw_block, max(pos) FILTER (WHERE tagged_at IS NOT NULL) AS turn FROM levels GROUP BY ALL),
starts AS (
  SELECT page_id, raw_block, opened - 1 AS depth_start, above FROM walk WHERE started
  UNION ALL SELECT DISTINCT page_id, 0, 0, []::BIGINT[] FROM walk
), lows AS (
  SELECT page_id, raw_block, min(level) AS depth_low, min(level) FILTER (WHERE pos < turn OR (pos = turn AND half = 0)) AS before_tag, any_value(turn) AS turn
  FROM levels JOIN turns USING (page_id, raw_block) GROUP BY ALL
), depths AS (
  SELECT page_id, raw_block, depth_start, above, depth_low, CASE WHEN turn IS NOT NULL THEN coalesce(before_tag, depth_start) END AS depth_tag FROM starts LEFT JOIN lows USING (page_id, raw_block)
), gains AS (
  SELECT page_id, raw_block, list(number ORDER BY pos) AS nodes, list(points ORDER BY pos) AS points FROM walk WHERE entered GROUP BY ALL
), spans AS (
  SELECT *, max(raw_block) FILTER (WHERE depth_tag IS NOT NULL) OVER (PARTITION BY page_id, run) AS turn
  FROM runs JOIN depths USING (page_id, raw_block) LEFT JOIN gains USING (page_id, raw_block)
), ran AS (
  SELECT page_id, run, min(CASE WHEN raw_block < turn THEN depth_low WHEN raw_block = turn THEN depth_tag END) AS lowest, min_by(depth_start, raw_block) AS first_depth,
    flatten(list(nodes ORDER BY raw_block) FILTER (WHERE nodes IS NOT NULL)) AS nodes, flatten(list(points ORDER BY raw_block) FILTER (WHERE points IS NOT NULL)) AS points
  FROM spans GROUP BY page_id, run
), placed_blocks AS (
  SELECT b.*, d.above, least(r.lowest, r.first_depth)::INT AS min_depth, coalesce(r.nodes, []) AS nodes, coalesce(r.points, []) AS points
  FROM blocks b JOIN depths d USING (page_id, raw_block) JOIN ran r USING (page_id, run)
)"""
READABLE = f"""{DOM}, given AS (SELECT page_id, unnest(nodes) AS node, unnest(points) AS p FROM placed_blocks),
gained AS (SELECT page_id, above[-1] AS node, sum(1 + least(n_bytes // 100, 3)) AS gain FROM placed_blocks WHERE n_bytes > 25 AND start_tag IN ('div', 'p') AND len(above) > 0 GROUP BY ALL),
under AS (SELECT page_id, block_idx, unnest(above) AS node, link_density * n_bytes AS linked, n_bytes AS size FROM placed_blocks),
nodes AS (
  SELECT page_id, node, (coalesce((SELECT sum(p) FROM given g WHERE g.page_id = v.page_id AND g.node = v.node), 0) + gain)
    * (1 - coalesce((SELECT sum(linked) FROM under u WHERE u.page_id = v.page_id AND u.node = v.node), 0) / greatest(coalesce((SELECT sum(size) FROM under u WHERE u.page_id = v.page_id AND u.node = v.node), 0), 1)) AS score
  FROM gained v
), bests AS (SELECT page_id, greatest(max(score), 1.0) AS best FROM nodes GROUP BY page_id),
topped AS (SELECT u.page_id, u.block_idx, greatest(max(score / best), 0.0) AS readability FROM under u JOIN nodes USING (page_id, node) JOIN bests USING (page_id) GROUP BY ALL),
readable AS (SELECT b.*, coalesce(readability, 0.0) AS readability FROM placed_blocks b LEFT JOIN topped USING (page_id, block_idx))"""


TURNS = r"""
words AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda t: t <> '') AS w FROM conversations),
pairs AS (SELECT a.conv_id, b.turn, b.w AS predicted, a.w AS actual FROM words a JOIN words b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _scores(both: str, predicted: str, actual: str) -> str:
    p = f"CASE WHEN {predicted} > 0 THEN {both}::DOUBLE / {predicted} ELSE 0 END"
    r = f"CASE WHEN {actual} > 0 THEN {both}::DOUBLE / {actual} ELSE 0 END"
    return f"round({p}, 6) AS precision, round({r}, 6) AS recall, round(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END, 6) AS f1"


def _lagged() -> str:
    parts = []
    for by, names in ((1, ("k_prev_ld", "k_prev_td")), (0, ("k_ld", "k_td")), (-1, ("k_next_ld", "k_next_td"))):
        for c, n in zip(("link_density", "text_density"), names):
            value = c if not by else f"{'lag' if by > 0 else 'lead'}({c}, 1, 0.0) OVER (PARTITION BY page_id ORDER BY block_idx)"
            parts.append(f"round(CASE WHEN count(*) OVER (PARTITION BY page_id) >= 3 THEN {value} END, 6) AS {n}")
    return ", ".join(parts)


_CSS = ", ".join(f"contains(css_{a}, '{w}')::INT AS css_{a}_{w}" for a, words in tags.CSS_WORDS.items() for w in words)
_VALUES = ("link_density", "text_density")
_STANDARD = ", ".join(f"round((CASE WHEN count(*) OVER () > 0 THEN {c} - avg({c}) OVER () END) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) AS {c}" for c in _VALUES)

def _scored() -> str:
    """Blocks with all features, the probability of the default model, and the decision."""
    columns, weights, intercept = model.DEFAULT.columns, model.DEFAULT.weights, model.DEFAULT.intercept
    total = " + ".join([f"{intercept!r}::DOUBLE", *(f"{c} * {w!r}::DOUBLE" for c, w in zip(columns, weights))])
    raw = _lagged().replace("round(", "(").replace(", 6) AS", ") AS")
    return f"""{READABLE}{_SMOOTH}, dense AS (SELECT page_id, block_idx, text, readability, {raw} FROM readable),
scored AS (SELECT page_id, block_idx, text, 1 / (1 + exp(-({total}))) AS prob FROM dense JOIN smooth USING (page_id, block_idx)),
chosen AS (SELECT *, coalesce((prob > 0.5)::INT, 0) AS pred FROM scored)"""


_WHOLE = f"WITH RECURSIVE {_scored()} SELECT p.page_id, coalesce(string_agg(text, chr(10) ORDER BY block_idx), '') AS content FROM pages p LEFT JOIN (SELECT * FROM chosen WHERE pred = 1) USING (page_id) GROUP BY p.page_id"

#: Longest common subsequences and edit distances by diagonals of the table: what is on
#: one follows from those before. d counts diagonals, i places of the first list on them.
_PAIRED = f"""{TURNS}, sized AS (SELECT conv_id, turn, predicted AS x, actual AS y, len(predicted) AS n, len(actual) AS m FROM pairs)"""
LCS = f"""{_PAIRED}, lcs(conv_id, turn, x, y, n, m, d, c, c1) AS (
  SELECT conv_id, turn, x, y, n, m, 0::BIGINT, [0::BIGINT], []::BIGINT[] FROM sized
  UNION ALL
  SELECT conv_id, turn, x, y, n, m, d + 1, list_transform(range(0, least(d + 1, n) + 1), lambda i:
    CASE WHEN i = 0 OR d + 1 - i <= 0 OR d + 1 - i > m THEN CASE WHEN d + 1 - i > m THEN NULL ELSE 0 END
      WHEN x[i] = y[d + 1 - i] THEN c1[i] + 1 ELSE greatest(coalesce(c[i], 0), coalesce(c[i + 1], 0)) END), c
  FROM lcs WHERE d < n + m
), diagonals AS MATERIALIZED (SELECT conv_id, turn, d, c FROM lcs),
back(conv_id, turn, x, y, i, j, move) AS (
  SELECT conv_id, turn, x, y, n, m, ''  FROM sized
  UNION ALL
  SELECT conv_id, turn, x, y, CASE WHEN move = '+' THEN i ELSE i - 1 END, CASE WHEN move = '-' THEN j ELSE j - 1 END, move FROM (
    SELECT b.conv_id, b.turn, b.x, b.y, b.i, b.j,
      CASE WHEN b.i > 0 AND b.j > 0 AND b.x[b.i] = b.y[b.j] THEN ' ' WHEN b.i = 0 THEN '+' WHEN b.j = 0 THEN '-' WHEN t.c[b.i + 1] >= t.c[b.i] THEN '+' ELSE '-' END AS move
    FROM back b JOIN diagonals t ON t.conv_id = b.conv_id AND t.turn = b.turn AND t.d = b.i + b.j - 1 WHERE b.i + b.j > 0
  )
)"""
OSA = f"""{_PAIRED}, osa(conv_id, turn, x, y, n, m, d, c, c1, c2, c3) AS (
  SELECT conv_id, turn, x, y, n, m, 0::BIGINT, [0::BIGINT], []::BIGINT[], []::BIGINT[], []::BIGINT[] FROM sized
  UNION ALL
  SELECT conv_id, turn, x, y, n, m, d + 1, list_transform(range(0, least(d + 1, n) + 1), lambda i:
    CASE WHEN d + 1 - i > m OR d + 1 - i < 0 THEN NULL WHEN i = 0 OR d + 1 - i = 0 THEN d + 1
      ELSE least(c[i] + 1, c[i + 1] + 1, c1[i] + CASE WHEN x[i] = y[d + 1 - i] THEN 0 ELSE 1 END,
        CASE WHEN i > 1 AND d + 1 - i > 1 AND x[i] = y[d - i] AND x[i - 1] = y[d + 1 - i] THEN c3[i - 1] + 1 END) END), c, c1, c2
  FROM osa WHERE d < n + m
)"""
CENTERS = [[0.0, 0.0], [60.0, 20.0], [200.0, 90.0]]
_FAR = ", ".join(f"pow(w_smooth - {a}, 2) + pow(w_absdiff - {b}, 2)" for a, b in CENTERS)
_VARIANTS = {
    "plain": "",
    "tag_count": ", tagcount, tagcount_since_last_block, n_anchors AS anchor_count, min_depth AS min_depth_since_last_block, css_id, css_class",
    "tag_count_no_css": ", tagcount, tagcount_since_last_block, n_anchors AS anchor_count, min_depth AS min_depth_since_last_block",
}
_NODES = ", array_to_string(above, ' ') AS ancestors, array_to_string(list_transform(list_zip(nodes, points), lambda x: x[1]::VARCHAR || ':' || x[2]::VARCHAR), ' ') AS readability_class_weights, start_tag AS block_start_tag"
_VARIANTS |= {f"{name}_readability": _VARIANTS[name] + _NODES for name in ("tag_count", "tag_count_no_css")}
_WORDS = r"list_filter(regexp_split_to_array(text, '[^\pL\pN]+'), lambda t: t <> '')"

SQL: dict[str, str] = {
    "min_depths": f"WITH RECURSIVE {DOM} SELECT page_id, block_idx, min_depth AS min_depth_since_last_block FROM placed_blocks",
    "block_ancestors": f"""WITH RECURSIVE {DOM} SELECT page_id, block_idx, start_tag AS block_start_tag, array_to_string(above, ' ') AS ancestors,
  array_to_string(list_transform(list_zip(nodes, points), lambda x: x[1]::VARCHAR || ':' || x[2]::VARCHAR), ' ') AS class_weights FROM placed_blocks""",
    "readability_scores": f"WITH RECURSIVE {READABLE} SELECT page_id, block_idx, round(readability, 6) AS readability FROM readable",
    "block_probabilities": f"WITH RECURSIVE {_scored()} SELECT page_id, block_idx, round(prob, 6) AS prob, pred FROM chosen",
    "extracted_content": _WHOLE,
    "streamed_content": _WHOLE,
    "page_encoding": r"""
SELECT page_id, coalesce(
  nullif(regexp_extract(substr(html, 1, 1024), '(?i)^<\?[^\n]*?encoding\s*?=\s*?[''"]([^\n]*?)[''"][^\n]*?\?>', 1), ''),
  nullif(regexp_extract(substr(html, 1, greatest(2048, floor(strlen(html) * 0.05)::INT)), '(?i)<\s*meta[^>]+charset\s*?=\s*?[''"]?([^>]*?)[ /;''">]', 1), ''), 'utf-8') AS encoding FROM pages""",
    "page_events": f"WITH {EVENTS} SELECT * FROM events",
    "page_texts": f"WITH {RAW} SELECT page_id, {_squeeze('string_agg(text, chr(32) ORDER BY pos)')} AS text FROM placed WHERE is_read GROUP BY page_id",
    "raw_blocks": f"WITH {RAW} SELECT * FROM raw",
    "page_blocks": f"WITH {BLOCKS} SELECT page_id, block_idx, text, link_text, start_tag AS block_start_tag, css_id, css_class, n_bytes FROM blocks",
    "block_density": f"WITH {BLOCKS} SELECT page_id, block_idx, round(link_density, 6) AS link_density, round(text_density, 6) AS text_density FROM blocks",
    "tag_counts": f"WITH {BLOCKS} SELECT page_id, block_idx, tagcount, tagcount_since_last_block, n_anchors AS anchor_count FROM blocks",
    "css_features": f"WITH {BLOCKS} SELECT page_id, block_idx, {_CSS}, contains(css_id, 'ss')::INT AS css_id_ss_again FROM blocks",
    "kohlschuetter_features": f"WITH {BLOCKS} SELECT page_id, block_idx, {_lagged()} FROM blocks",
    "ctr_smoothed": f"WITH {SMOOTH} SELECT page_id, block_idx, round(w_smooth, 6) AS w_smooth, round(w_absdiff, 6) AS w_absdiff FROM smooth",
    "feature_standardised": f"WITH {BLOCKS} SELECT page_id, block_idx, {_STANDARD} FROM blocks",
    "enough_blocks": f"WITH {BLOCKS} SELECT page_id, count(*) AS n_blocks FROM blocks GROUP BY page_id HAVING count(*) >= 3",
    "document_words": r"""
SELECT doc_id, len(w)::INT AS n_words, len(list_distinct(w))::INT AS n_distinct FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\pL\pN]+'), lambda t: t <> '') AS w FROM documents)""",
    "token_overlap": f"WITH {TURNS} SELECT conv_id, turn, {_scores('len(list_intersect(predicted, actual))', 'len(list_distinct(predicted))', 'len(list_distinct(actual))')} FROM pairs",
    "token_overlap_counted": f"""WITH {TURNS}, each AS (
  SELECT conv_id, turn, unnest(predicted) AS token, 1 AS p, 0 AS a FROM pairs UNION ALL SELECT conv_id, turn, unnest(actual), 0, 1 FROM pairs
), counts AS (SELECT conv_id, turn, token, sum(p) AS p, sum(a) AS a FROM each GROUP BY ALL),
sums AS (SELECT conv_id, turn, sum(least(p, a)) AS both_, sum(p) AS p, sum(a) AS a FROM counts GROUP BY ALL),
filled AS (SELECT conv_id, turn, coalesce(both_, 0) AS both_, coalesce(p, 0) AS p, coalesce(a, 0) AS a FROM pairs LEFT JOIN sums USING (conv_id, turn))
SELECT conv_id, turn, {_scores('both_', 'p', 'a')} FROM filled""",
    "token_jaccard": f"""WITH {TURNS} SELECT conv_id, turn,
  round(CASE WHEN len(list_distinct(list_concat(predicted, actual))) > 0 THEN len(list_intersect(predicted, actual))::DOUBLE / len(list_distinct(list_concat(predicted, actual))) END, 6) AS jaccard FROM pairs""",
    "block_metrics": rf"""WITH {BLOCKS}, scored AS (
  SELECT start_tag, start_tag = 'p' AS a, text_density > 8 AND link_density < 0.3 AS p, len(regexp_split_to_array(text, ' '))::DOUBLE AS w FROM blocks
), sums AS (
  SELECT coalesce(sum(w) FILTER (WHERE a AND p), 0) AS tp, coalesce(sum(w) FILTER (WHERE p), 0) AS pp, coalesce(sum(w) FILTER (WHERE a), 0) AS aa,
    coalesce(sum(w) FILTER (WHERE a = p), 0) AS ok, coalesce(sum(w), 0) AS n FROM scored
) SELECT round(CASE WHEN n > 0 THEN ok / n ELSE 0 END, 6) AS accuracy, {_scores('tp', 'pp', 'aa')} FROM sums""",
    "osa_distance": f"WITH RECURSIVE {OSA} SELECT conv_id, turn, c[n + 1]::INT AS distance FROM osa WHERE d = n + m",
    "lcs_inclusion": f"""WITH RECURSIVE {LCS} SELECT conv_id, turn, coalesce(string_agg(CASE WHEN move = ' ' THEN '1' ELSE '0' END, '' ORDER BY i) FILTER (WHERE move IN (' ', '-')), '') AS flags
FROM back GROUP BY conv_id, turn""",
    "token_diff": f"""WITH RECURSIVE {LCS} SELECT conv_id, turn, coalesce(string_agg(move || ' ' || CASE WHEN move = '+' THEN y[j + 1] ELSE x[i + 1] END, chr(10) ORDER BY i + j) FILTER (WHERE move <> ''), '') AS diff
FROM back GROUP BY conv_id, turn""",
    "ctr_clusters": f"WITH {SMOOTH}, far AS (SELECT page_id, block_idx, [{_FAR}] AS f FROM smooth) SELECT page_id, block_idx, (f[1] > list_min(f))::INT AS cw FROM far",
    "unprocessed_pages": f"WITH {BLOCKS} SELECT page_id FROM pages WHERE page_id NOT IN (SELECT page_id FROM blocks WHERE text_density > 12)",
    "casts": "SELECT conv_id, turn, strlen(text)::INT AS n_bytes, text, role || '|' || text AS list, text AS map FROM conversations",
    "gold_block_files": f"WITH {BLOCKS} SELECT page_id, block_idx, len({_WORDS})::INT AS n_tokens, array_to_string({_WORDS}, ' ') AS block_tokens FROM blocks",
    "stored_model": _WHOLE,
    **{f"blocks_{name}": f"WITH RECURSIVE {DOM} SELECT page_id, block_idx, text, link_text, round(link_density, 6) AS link_density, round(text_density, 6) AS text_density, n_bytes{columns} FROM placed_blocks" for name, columns in _VARIANTS.items()},
}
