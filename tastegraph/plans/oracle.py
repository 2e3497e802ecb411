"""The queries' results as standalone SQL (DuckDB dialect), written from the definitions and not from the DataFrame code."""

from __future__ import annotations

from ..fixed import KEY_ARTICLES, PART_PATTERN, ROMAN_PATTERN, SHOWN_ARTICLES

SEED = 20260730
#: Support under which the rankable-only table leaves items out: some, at every size of the tables.
RANKABLE_FLOOR = 0.5


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_depth = 0


def let(value: str, body) -> str:
    """``body`` over a name bound to ``value`` (a one-element list, so that it is computed once)."""
    global _depth
    _depth += 1
    v = f"v{_depth}"
    return f"list_transform([{value}], lambda {v}: {body(v)})[1]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    plain = rf"regexp_replace({x}, '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g')"
    return strip(rf"regexp_replace({plain}, '\s+', ' ', 'g')")


def around_comma(x: str, group: int) -> str:
    return strip(f"regexp_extract({x}, '(?s)^(.*),([^,]*)$', {group})")


def norm(x: str) -> str:
    def turned(s: str) -> str:
        return let(around_comma(s, 2), lambda t: f"CASE WHEN {t} IN {_in(KEY_ARTICLES)} THEN {t} || ' ' || {around_comma(s, 1)} ELSE {s} END")

    return words(let(f"replace({strip(f'lower(strip_accents({x}))')}, '&', ' and ')", turned))


def bare(k: str) -> str:
    return f"CASE WHEN regexp_extract({k}, '(?s)^[^ ]* (.+)$', 1) <> '' AND split_part({k}, ' ', 1) IN {_in(KEY_ARTICLES)} THEN regexp_extract({k}, '(?s)^[^ ]* (.+)$', 1) ELSE {k} END"


def ordered_distinct(x: str) -> str:
    return let(x, lambda v: f"list_filter({v}, lambda e, i: list_position({v}, e) = i)")


def keys(x: str) -> str:
    return let(norm(x), lambda k: f"CASE WHEN {k} = '' THEN CAST([] AS VARCHAR[]) WHEN {bare(k)} = {k} THEN [{k}] ELSE [{k}, {bare(k)}] END")


def alternates(x: str) -> str:
    return rf"regexp_extract_all({x}, '\(([^()]*)\)', 1)"


def variants(x: str) -> str:
    inner = let("a", lambda a: keys(strip(rf"regexp_replace({strip(a)}, '^\s*(?i:aka|a\.k\.a\.?)\s*', '')")))
    outer = strip(rf"regexp_replace({x}, '\([^()]*\)', '', 'g')")
    return ordered_distinct(f"list_concat(list_concat({keys(outer)}, flatten(list_transform({alternates(x)}, lambda a: {inner}))), {keys(x)})")


def unrotate(x: str) -> str:
    def turned(t: str) -> str:
        joint = f"CASE WHEN {t} LIKE '%''' OR {t} LIKE '%’' THEN '' ELSE ' ' END"
        return f"CASE WHEN lower({t}) IN {_in(SHOWN_ARTICLES)} THEN {t} || {joint} || {around_comma(x, 1)} ELSE {x} END"

    return let(around_comma(x, 2), turned)


def simple(x: str) -> str:
    return words(rf"lower(regexp_replace({x}, '\([^()]*\)', ' ', 'g'))")


_PART, _ROMAN = "(?i)" + PART_PATTERN, "(?i)" + ROMAN_PATTERN


def parts(x: str) -> str:
    """[base title, 'y' if it had a part marker]"""

    def of(base: str) -> str:
        cut = let(f"regexp_replace({base}, '{_PART}', '')", lambda p: f"CASE WHEN {p} <> {base} THEN {p} ELSE regexp_replace({base}, '{_ROMAN}', '') END")
        return let(cut, lambda c: f"CASE WHEN {c} <> {base} AND length({simple(c)}) >= 3 THEN [{c}, 'y'] ELSE [{base}, 'n'] END")

    return let(let(strip(rf"regexp_replace({x}, '\([^()]*\)', ' ', 'g')"), unrotate), of)


def work(x: str, year: str) -> str:
    return let(parts(x), lambda p: f"CASE WHEN {p}[2] = 'y' THEN 'work::' || {simple(p + '[1]')} ELSE 'title::' || {simple(p + '[1]')} || '::' || coalesce(CAST({year} AS VARCHAR), '') END")


def series(x: str) -> str:
    return let(simple(f"split_part({x}, ':', 1)"), lambda h: f"CASE WHEN contains({x}, ':') AND length({h}) >= 4 THEN {h} END")


def shown(x: str) -> str:
    t = let(strip(rf"regexp_replace({x}, '\([^()]*\)', '', 'g')"), unrotate)
    return f"coalesce(nullif({strip(rf'''regexp_replace({t}, '\s+', ' ', 'g')''')}, ''), {x})"


def bases(x: str) -> str:
    outer = rf"regexp_replace({x}, '\([^()]*\)', ' ', 'g')"
    base = lambda t: let(parts(t), lambda p: simple(p + "[1]"))
    every = f"list_concat([{base(outer)}, {base(let(outer, unrotate))}], list_transform({alternates(x)}, lambda a: {base('a')}))"
    return f"list_sort(list_distinct(list_filter({every}, lambda b: length(b) >= 3)))"


# views

EV = """ev AS (SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS BIGINT) AS item,
  least(5.0e0, greatest(0.5e0, round(avg(value) / 10) / 2)) AS rating FROM events GROUP BY 1, 2)"""
LI = """li AS (SELECT o_custkey AS "user", l_partkey AS item, greatest(0.5e0, round(avg(l_quantity) / 5) / 2) AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
CATALOGUE = """catalogue AS (SELECT p_partkey AS item, p_name AS clean_title, CAST(CASE WHEN p_partkey % 11 <> 0 THEN p_size + 1950 END AS INTEGER) AS year,
  p_type AS title_type, CAST(p_partkey AS VARCHAR) AS catalogue_id FROM part)"""
_CAP = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
ITEMS = f"""items AS (SELECT p_partkey AS item, CASE p_partkey % 5
    WHEN 0 THEN {_CAP} || ' Part ' || ['I', 'II', 'III', 'IV'][p_partkey % 4 + 1] WHEN 1 THEN {_CAP} || ', The'
    WHEN 2 THEN 'Saga of ' || {_CAP} || ': Chapter' WHEN 3 THEN {_CAP} || ' (a.k.a. The ' || {_CAP} || ')' ELSE {_CAP} END AS clean_title,
  CAST(p_size + 1950 AS INTEGER) AS year, p_type AS title_type FROM part)"""
FILMS = """films AS (SELECT p_partkey AS film_id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || ', The'
    WHEN 2 THEN p_name[1:2] || p_name[4:] WHEN 3 THEN 'The ' || upper(p_name) ELSE split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) END AS title,
  CAST(CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN p_size + 1951 WHEN 2 THEN p_size + 1956 ELSE p_size + 1950 END AS INTEGER) AS year,
  0.5e0 + (p_partkey % 10) / 2 AS rating FROM part)"""
MEMBERS = """members AS (SELECT o_custkey AS "user", 'Order ' || CAST(o_orderkey % 50 AS VARCHAR) AS title,
  CAST(CASE WHEN o_orderkey % 9 <> 0 THEN year(o_orderdate) END AS INTEGER) AS year, greatest(0.5e0, least(5.0e0, round(o_totalprice / 50000) / 2)) AS rating,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS logged_date, o_orderkey AS ord, o_orderstatus, o_orderpriority FROM orders)"""
Z = """z AS (SELECT "user", item, rating, (rating - avg(rating) OVER w) / greatest(stddev_pop(rating) OVER w, 0.5e0) AS z FROM ev WINDOW w AS (PARTITION BY "user"))"""
STATS = """stats AS (SELECT item, CAST(count(*) AS INTEGER) AS n_ratings, avg(rating) AS mean_rating, avg(z) * count(*) / (count(*) + 30.0e0) AS z_mean FROM z GROUP BY item)"""
LI_STATS = "li_stats AS (SELECT item, CAST(count(*) AS INTEGER) AS n_ratings, avg(rating) AS mean_rating FROM li GROUP BY item)"
RATED = """rated AS (SELECT "user", item, rating, z FROM z)"""
HOLD = f"""eligible AS (SELECT "user" FROM ev GROUP BY "user" HAVING count(*) BETWEEN 20 AND 100000),
hold AS (SELECT "user" FROM (SELECT "user", row_number() OVER (ORDER BY md5('{SEED}:' || "user"), "user") AS r FROM eligible) WHERE r <= least(300, ceil((SELECT count(*) FROM eligible) * 0.2e0)))"""


def half(source: str = "z", centered: bool = False, lam: float = 60.0, where: str = "") -> str:
    value = "z - avg(z) OVER (PARTITION BY item)" if centered else "z"
    return f"""c AS (SELECT "user", item, {value} AS z FROM {source} {where}),
v AS (SELECT "user", item, z / CASE WHEN sum(z * z) OVER (PARTITION BY item) = 0 THEN 1 ELSE sqrt(sum(z * z) OVER (PARTITION BY item)) END AS v FROM c),
half AS (SELECT a.item AS i, b.item AS j, sum(a.v * b.v) * count(*) / (count(*) + {lam}e0) AS sim, count(*) AS n_co
  FROM v a JOIN v b ON a."user" = b."user" AND a.item < b.item GROUP BY a.item, b.item)"""


def edges(k: int = 50) -> str:
    return f"""edges AS (SELECT i, j, sim, n_co FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(abs(sim), 9) DESC, j) AS r
  FROM (SELECT i, j, sim, n_co FROM half UNION ALL SELECT j, i, sim, n_co FROM half) WHERE sim <> 0) WHERE r <= {k})"""


def scores(rated: str = "rated", by: tuple = ('"user"',), residual: bool = True, alpha: float = 0.15, beta: float = 1.0, floor: float = 0.03, pred_k: float = 0.0, rank_k: float = 1.0, every: bool = True, name: str = "scores") -> str:
    k = ", ".join(by)
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in by)
    value = "r.z - coalesce(s.z_mean, 0)" if residual else "r.z"
    pred = f"CASE WHEN den > 1e-9 THEN num / den ELSE 0 END{f' * den / (den + {pred_k}e0)' if pred_k else ''}"
    trust = f"den / (den + {rank_k}e0)" if rank_k else "1"
    base = f"{beta}e0 * z_mean + ({pred}) * {trust}" if residual else f"({pred}) * {trust}"
    join = "LEFT JOIN" if every else "JOIN"
    return f"""{name}_e AS (SELECT {", ".join("r." + x for x in by)}, e.j AS item, sum(e.sim * ({value})) AS num, sum(abs(e.sim)) AS den, count(*) AS cnt
  FROM {rated} r LEFT JOIN stats s ON r.item = s.item JOIN edges e ON e.i = r.item GROUP BY {", ".join("r." + x for x in by)}, e.j),
{name}_p AS (SELECT {", ".join("u." + x for x in by)}, s.item, coalesce(num, 0) AS num, coalesce(den, 0) AS den, coalesce(cnt, 0) AS cnt, n_ratings, mean_rating, z_mean
  FROM (SELECT DISTINCT {k} FROM {rated}) u CROSS JOIN stats s {join} {name}_e e ON {on("e", "u")} AND e.item = s.item
  WHERE NOT EXISTS (SELECT 1 FROM {rated} r WHERE {on("r", "u")} AND r.item = s.item)),
{name} AS (SELECT {k}, item, {f"z_mean + ({pred})" if residual else pred} AS pred_z, {pred if residual else "CAST(NULL AS DOUBLE)"} AS pred_d, den AS support, CAST(cnt AS INTEGER) AS n_neighbours,
  CASE WHEN den >= {floor}e0 THEN {base} - {alpha}e0 * log10(greatest(n_ratings, 1) / (SELECT median(n_ratings) FROM stats WHERE n_ratings > 0)) END AS rank_score,
  den >= {floor}e0 AS scoreable, n_ratings, mean_rating, z_mean FROM {name}_p)"""


def q(select: str, *ctes: str) -> str:
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + select


BUILD = (EV, Z, half(), edges(), STATS)


def _score_query(**kw) -> str:
    return q('SELECT "user", item, round(pred_z, 6) AS pred_z, round(pred_d, 6) AS pred_d, round(support, 6) AS support, n_neighbours, round(rank_score, 6) AS rank_score, scoreable FROM scores', *BUILD, RATED, scores(**kw))


def _why(top: int, source: str) -> str:
    """why: the loudest ratings for and against each ("user", item) of ``source``."""
    return f"""said AS (SELECT r."user", w.item AS candidate, r.item, e.sim * (r.z - coalesce(s.z_mean, 0)) AS contribution
  FROM {source} w JOIN rated r ON r."user" = w."user" JOIN edges e ON e.i = r.item AND e.j = w.item LEFT JOIN stats s ON s.item = r.item),
why AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user", candidate ORDER BY round(abs(contribution), 9) DESC, item) AS place FROM said) WHERE place <= {top})"""


NAMED = f"""named AS (SELECT item, clean_title, title_type, {work("clean_title", "year")} AS work, {series("clean_title")} AS series, {bases("clean_title")} AS bases, {shown("clean_title")} AS shown FROM items),
started AS (SELECT DISTINCT r."user", unnest(n.bases) AS base FROM rated r JOIN named n ON r.item = n.item)"""


def _list(name: str, scores: str, window: str = "", filters: bool = True) -> str:
    """``name``: a ranked list (place) out of a scores table."""
    ranked = f"""{name}_r AS (SELECT s.*, n.clean_title, n.work, n.series, n.bases, row_number() OVER (PARTITION BY s."user" ORDER BY round(rank_score, 9) DESC, s.item) AS rank
  FROM {scores} s JOIN named n ON s.item = n.item WHERE scoreable{window})"""
    if not filters:
        return f"{ranked}, {name} AS (SELECT *, rank AS place FROM {name}_r)"
    return f"""{ranked},
{name}_p AS (SELECT "user", item, unnest(bases) AS base FROM {name}_r WHERE work LIKE 'work::%'),
{name}_0 AS (SELECT * FROM {name}_r r WHERE pred_z >= 0 AND n_neighbours >= 2
  AND NOT EXISTS (SELECT 1 FROM {name}_p p JOIN started s ON p."user" = s."user" AND p.base = s.base WHERE p."user" = r."user" AND p.item = r.item)),
{name}_1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user", work ORDER BY rank) AS a FROM {name}_0) WHERE a = 1),
{name}_2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user", series ORDER BY rank) AS b FROM {name}_1) WHERE series IS NULL OR b <= 2),
{name} AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY rank) AS place FROM {name}_2)"""


def _recommend(alpha: float, floor: float = 0.03, least: int | None = None, most: int | None = None, filters: bool = True) -> str:
    window = (f" AND n_ratings >= {least}" if least is not None else "") + (f" AND n_ratings <= {most}" if most is not None else "")
    because = """firsts AS (SELECT w.*, n.shown, row_number() OVER (PARTITION BY w."user", candidate, lower(n.shown) ORDER BY place) AS a FROM why w JOIN named n ON n.item = w.item),
three AS (SELECT *, row_number() OVER (PARTITION BY "user", candidate ORDER BY place) AS b FROM firsts WHERE a = 1),
because AS (SELECT "user", candidate AS item, string_agg(CASE WHEN contribution > 0 THEN '+' ELSE '-' END || shown, ', ' ORDER BY b) AS because FROM three WHERE b <= 3 GROUP BY 1, 2),
scale AS (SELECT "user", avg(rating) AS mean, greatest(stddev_pop(rating), 0.5e0) AS sigma FROM rated GROUP BY 1)"""
    select = """SELECT l."user", CAST(place AS INTEGER) AS place, l.item, clean_title, round(rank_score, 6) AS rank_score, round(pred_z, 6) AS pred_z, round(pred_d, 6) AS pred_d, round(support, 6) AS support,
  n_neighbours, n_ratings, because, round(greatest(0.5e0, least(5.0e0, mean + sigma * 1.17e0 * pred_z)), 6) AS predicted_stars, round(greatest(0.5e0, least(5.0e0, mean + sigma * z_mean)), 6) AS crowd_stars
  FROM listed l JOIN scale USING ("user") LEFT JOIN because b ON b."user" = l."user" AND b.item = l.item"""
    return q(select, *BUILD, RATED, ITEMS, NAMED, scores(alpha=alpha, floor=floor, every=False), _list("kept", "scores", window, filters), "listed AS (SELECT * FROM kept WHERE place <= 10)", _why(12, "listed"), because)


_DENIED = "title_type IN ('ECONOMY', 'PROMO')"


def _sections() -> str:
    """Three lists, the items of earlier ones left out of later ones."""
    parts, before = [], ""
    for k, (alpha, floor, window) in enumerate(((0.15, 0.03, ""), (0.4, 0.01, " AND n_ratings <= 3000"), (0.0, 0.03, " AND n_ratings >= 60"))):
        allowed = f" AND NOT coalesce({_DENIED}, false){window}{before}"
        parts += [scores(alpha=alpha, floor=floor, every=False, name=f"s{k}"), _list(f"l{k}", f"s{k}", allowed), f"""t{k} AS (SELECT "user", item, clean_title, place FROM l{k} WHERE place <= 5)"""]
        before += f""" AND NOT EXISTS (SELECT 1 FROM t{k} t WHERE t."user" = s."user" AND t.item = s.item)"""
    every = "\nUNION ALL ".join(f"""SELECT "user", '{name}' AS section, CAST(place AS INTEGER) AS place, item, clean_title FROM t{k}""" for k, name in enumerate(("balanced", "gem", "blindspot")))
    return q(every, *BUILD, RATED, ITEMS, NAMED, *parts)


# evaluation

HELD_EDGES = (EV, Z, HOLD, half(where='WHERE "user" NOT IN (SELECT "user" FROM hold)'), edges(), STATS)


def _split(users: str) -> str:
    return f"""halves AS (SELECT "user", split, item, rating, z, row_number() OVER (PARTITION BY "user", split ORDER BY md5('{SEED}:' || split || ':' || "user" || ':' || item), item)
    <= greatest(round_even(count(*) OVER (PARTITION BY "user", split) * 0.2e0, 0), 1) AS test
  FROM (SELECT *, unnest([0, 1]) AS split FROM z {users}))"""


def _held(name: str = "", **kw) -> tuple[str, ...]:
    rank = lambda x, r: f"""row_number() OVER (PARTITION BY s."user", s.split ORDER BY {x}, s.item) AS {r}"""
    return (
        f"train{name} AS (SELECT * FROM halves WHERE NOT test)",
        scores(f"train{name}", ('"user"', "split"), name=f"scores{name}", **kw),
        f"""ranked{name} AS (SELECT s.*, t.rating, coalesce(t.z >= 0.5, false) AS relevant, count(*) OVER (PARTITION BY s."user", s.split) AS candidates,
  {rank("round(rank_score, 9) DESC NULLS LAST", "r0")}, {rank("round(coalesce(mean_rating, -1), 9) DESC", "r1")}, {rank("n_ratings DESC", "r2")},
  {rank(f'''substr(md5('{SEED}:' || s.split || ':' || s."user" || ':' || s.item), 1, 12)''', "r3")}
  FROM scores{name} s LEFT JOIN (SELECT * FROM halves WHERE test) t ON t."user" = s."user" AND t.split = s.split AND t.item = s.item)""",
        f"""obs{name} AS (SELECT "user", split, item, method, 'Q' || CAST(1 + len(list_filter((SELECT quantile_cont(n_ratings, [0.2, 0.4, 0.6, 0.8]) FROM stats), lambda c: c <= n_ratings)) AS VARCHAR) AS quintile,
  rank, candidates, 1 - (rank - 1) / greatest(candidates - 1, 1) AS percentile, scoreable
  FROM (SELECT *, unnest(['item-item CF', 'by consensus', 'by popularity', 'random']) AS method, unnest([r0, r1, r2, r3]) AS rank FROM ranked{name} WHERE relevant))""",
    )


EVALUATED = (*HELD_EDGES, _split('WHERE "user" IN (SELECT "user" FROM hold)'))
_QS = ("Q1", "Q2", "Q3", "Q4", "Q5")


def _table(obs: str, where: str = "true") -> str:
    cell = lambda f: ", ".join([*(f"round({f} FILTER (WHERE quintile = '{x}'), 6) AS {x}" for x in _QS), f'round({f}, 6) AS "ALL"'])
    own = f"FROM {obs} WHERE method = 'item-item CF'"
    return f"""SELECT method AS row, {cell("median(percentile)")} FROM {obs} WHERE {where} GROUP BY method
UNION ALL SELECT 'n', {", ".join(f"CAST(nullif(count(*) FILTER (WHERE quintile = '{x}'), 0) AS DOUBLE)" for x in _QS)}, CAST(count(*) AS DOUBLE) {own} AND {where} HAVING count(*) > 0
UNION ALL SELECT 'rankable', {cell("avg(CAST(scoreable AS INTEGER))")} {own} HAVING count(*) FILTER (WHERE {where}) > 0"""


def _swept(configs: tuple) -> str:
    """One row for each (name, arguments of scores), all over the same splits."""
    cell = lambda x: f"round(median(percentile) FILTER (WHERE quintile = '{x}'), 6) AS {x}"
    rows = "\nUNION ALL ".join(f"SELECT '{name}' AS config, * FROM obs{k} WHERE method = 'item-item CF'" for k, (name, _) in enumerate(configs))
    table = f"""swept AS ({rows}),
cells AS (SELECT config, count(*) AS n, round(avg(CAST(scoreable AS INTEGER)), 6) AS rankable, {", ".join(map(cell, _QS))}, round(median(percentile), 6) AS "ALL",
  {", ".join(f"median(percentile) FILTER (WHERE quintile = '{x}') AS m{x}" for x in _QS[:3])} FROM swept GROUP BY config)"""
    return q('SELECT config, n, rankable, Q1, Q2, Q3, Q4, Q5, "ALL", round(list_avg([mQ1, mQ2, mQ3]), 6) AS Q1_3 FROM cells', *EVALUATED, *[c for k, (_, kw) in enumerate(configs) for c in _held(str(k), **kw)], table)


#: The settings of the two sweeps, as arguments of ``scores``.
SWEEP = (
    ("before", {"residual": False, "rank_k": 0.0, "floor": 0.1}), ("defaults", {}), ("min_support 0.10", {"floor": 0.1}), ("min_support 0.01", {"floor": 0.01}), ("no rank shrinkage", {"rank_k": 0.0}),
    ("beta 0.5", {"beta": 0.5}), ("beta 0.0", {"beta": 0.0}), ("alpha 0.0", {"alpha": 0.0}), ("alpha 0.4", {"alpha": 0.4}),
)
COMPARE = (("legacy", {"residual": False}), ("residual, beta 1.0", {}), ("residual, beta 0.5", {"beta": 0.5}), ("residual, beta 0.0", {"beta": 0.0}))


def _metrics() -> str:
    at = []
    for k in (10, 20):
        at.append(f"round(coalesce(h{k} / greatest(n_relevant, 1), 0.0e0), 6) AS recall_{k}")
        at.append(f"round(coalesce(d{k} / list_sum(list_transform(range(1, CAST(greatest(least(n_relevant, {k}), 1) AS BIGINT) + 1), lambda r: 1 / log2(r + 1))), 0.0e0), 6) AS ndcg_{k}")
    sums = ", ".join(f"CAST(count(*) FILTER (WHERE rank <= {k}) AS DOUBLE) AS h{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= {k}), 0) AS d{k}" for k in (10, 20))
    return f"""SELECT "user", split, method, coalesce(n_relevant, 0) AS n_relevant, {", ".join(at)}, round(coalesce(med, 0.0e0), 6) AS median_percentile, round(coalesce(best, 0.0e0), 6) AS best_percentile
FROM (SELECT DISTINCT "user", split FROM halves) CROSS JOIN (SELECT unnest(['item-item CF', 'by consensus', 'by popularity', 'random']) AS method)
LEFT JOIN (SELECT "user", split, method, count(*) AS n_relevant, median(percentile) AS med, max(percentile) AS best, {sums} FROM obs GROUP BY 1, 2, 3) USING ("user", split, method)"""


# matching

INDEX = f"""entries AS (SELECT item, year, unnest({variants("clean_title")}) AS key FROM catalogue),
idx AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM entries)"""
ASKED = f"""asked AS (SELECT film_id, year, k AS keys FROM (SELECT film_id, year, {keys("title")} AS k FROM films))"""


def _exact(tolerance: int = 1, strict: bool = True) -> str:
    last = "" if strict else " WHEN n = 1 THEN 5"
    return f"""met AS (SELECT film_id, a.year, place, item, i.year AS item_year, abs(i.year - a.year) AS delta, n FROM (SELECT film_id, year, unnest(keys) AS key, unnest(range(len(keys))) AS place FROM asked) a JOIN idx i USING (key)),
ruled AS (SELECT *, CASE WHEN delta = 0 THEN 1 WHEN delta <= {tolerance} THEN 2 WHEN year IS NULL AND n = 1 THEN 3 WHEN year IS NOT NULL AND item_year IS NULL AND n = 1 THEN 4{last} END AS rule FROM met),
exact AS (SELECT film_id, item, item_year, ['exact title+year', 'exact title, year +/-1', 'exact title, no year given', 'exact title, catalogue has no year', 'unique title, YEAR MISMATCH'][rule] AS method
  FROM (SELECT *, row_number() OVER (PARTITION BY film_id ORDER BY place, rule, coalesce(delta, 0), item) AS r FROM ruled WHERE rule IS NOT NULL) WHERE r = 1)"""


def _lcs(a: str, b: str) -> str:
    """Rows of the table of prefixes: each cell is the greatest so far of cells above and of matches on the diagonal."""
    step = "list_transform(range(1, len(y) + 1), lambda t: list_max(list_transform(range(1, t + 1), lambda u: greatest(acc[u + 1], CASE WHEN y[u] = ch THEN acc[u] + 1 ELSE 0 END))))"
    return f"list_reduce(string_split({a}, ''), lambda acc, ch: list_concat([0], {step.replace('len(y)', f'length({b})').replace('y[u]', f'{b}[u]')}), list_transform(range(length({b}) + 1), lambda o: 0))[length({b}) + 1]"


def _ratio(a: str, b: str) -> str:
    return let(a, lambda x: let(b, lambda y: f"CASE WHEN length({x}) + length({y}) = 0 THEN 100.0e0 WHEN length({x}) = 0 OR length({y}) = 0 THEN 0.0e0 ELSE 200.0e0 * {_lcs(x, y)} / (length({x}) + length({y})) END"))


_TOK = lambda x: f"list_sort(string_split({x}, ' '))"
_SETS = """(SELECT *, list_sort(list_intersect(ta, tb)) AS common, list_sort(list_filter(ta, lambda t: NOT list_contains(tb, t))) AS la, list_sort(list_filter(tb, lambda t: NOT list_contains(ta, t))) AS lb
  FROM (SELECT *, list_distinct(string_split(q, ' ')) AS ta, list_distinct(string_split(key, ' ')) AS tb FROM (SELECT DISTINCT q, key FROM band)))"""
FUZZY = f"""rest AS (SELECT film_id, year, keys[1] AS q FROM asked WHERE year IS NOT NULL AND len(keys) > 0 AND film_id NOT IN (SELECT film_id FROM exact)),
pool AS (SELECT key, year AS item_year, min(item) AS item FROM idx WHERE year IS NOT NULL GROUP BY 1, 2),
band AS (SELECT DISTINCT q, r.year, key, item_year, item FROM rest r JOIN pool p ON p.item_year BETWEEN r.year - 1 AND r.year + 1),
compared AS (SELECT q, key, {_ratio(f"array_to_string({_TOK('q')}, ' ')", f"array_to_string({_TOK('key')}, ' ')")} AS s,
  CASE WHEN len(common) > 0 AND (len(la) = 0 OR len(lb) = 0) THEN 100.0e0 ELSE greatest({_ratio("array_to_string(list_concat(common, la), ' ')", "array_to_string(list_concat(common, lb), ' ')")},
    CASE WHEN len(common) > 0 THEN {_ratio("array_to_string(common, ' ')", "array_to_string(list_concat(common, la), ' ')")} ELSE 0 END,
    CASE WHEN len(common) > 0 THEN {_ratio("array_to_string(common, ' ')", "array_to_string(list_concat(common, lb), ' ')")} ELSE 0 END) END AS t FROM {_SETS}),
judged AS (SELECT band.*, CASE WHEN s >= 88 THEN 1 WHEN item_year = year AND t >= 95 THEN 2 END AS kind, CASE WHEN s >= 88 THEN s ELSE t END AS value FROM band JOIN compared USING (q, key)),
fuzzy AS (SELECT film_id, item, item_year, CASE kind WHEN 1 THEN 'fuzzy sort ' ELSE 'subset, exact year ' END || CAST(CAST(round_even(value, 0) AS INTEGER) AS VARCHAR) AS method
  FROM rest JOIN (SELECT *, row_number() OVER (PARTITION BY q, year ORDER BY kind, value DESC, item_year, key) AS r FROM judged WHERE kind IS NOT NULL) USING (q, year) WHERE r = 1)"""
MATCHED = """hits AS (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy),
matched AS (SELECT f.film_id, h.item, CASE WHEN h.item IS NOT NULL THEN coalesce(h.item_year, -9999) END AS item_year, method, n_ratings, mean_rating, rating - mean_rating AS residual
  FROM films f LEFT JOIN hits h USING (film_id) LEFT JOIN li_stats s ON s.item = h.item)"""
MATCHING = (CATALOGUE, INDEX, FILMS, ASKED, _exact())

# profiles

PROFILE = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user", title, year ORDER BY ord DESC) AS r FROM members) WHERE r = 1),
pstats AS (SELECT "user", count(*) AS n, avg(rating) AS mean, stddev_pop(rating) AS sigma_raw, greatest(stddev_pop(rating), 0.5e0) AS sigma, max(logged_date) AS reference_date FROM latest GROUP BY 1),
busy AS (SELECT "user", max(n) / sum(n) AS top_share, arg_min(d, (-n, d)) AS busiest FROM (SELECT "user", logged_date AS d, count(*) AS n FROM latest WHERE logged_date IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
aged AS (SELECT l.*, (rating - mean) / sigma AS z, date_diff('day', logged_date, reference_date) * 86400 AS age, reference_date FROM latest l JOIN pstats USING ("user")),
pfilms AS (SELECT a."user", title, year, rating,
  EXISTS (SELECT 1 FROM members m WHERE m."user" = a."user" AND m.title = a.title AND m.year IS NOT DISTINCT FROM a.year AND m.o_orderstatus = 'F') AS is_liked,
  EXISTS (SELECT 1 FROM members m WHERE m."user" = a."user" AND m.title = a.title AND m.year IS NOT DISTINCT FROM a.year AND m.o_orderpriority LIKE '1%' AND m.ord % 2 <> 0) AS has_review,
  z, coalesce(pow(0.5e0, greatest(coalesce(age, mid), 0) / 31557600.0e0 / 3.0e0), 1.0e0) AS weight
  FROM aged a LEFT JOIN (SELECT "user", median(age) AS mid FROM aged GROUP BY 1) m USING ("user"))"""

_FILTERED = "".join(
    f"""f{p}i AS (SELECT * FROM {src} WHERE item IN (SELECT item FROM {src} GROUP BY item HAVING count(*) >= 22)),
f{p}u AS (SELECT * FROM f{p}i WHERE "user" IN (SELECT "user" FROM f{p}i GROUP BY "user" HAVING count(*) >= 30)){"," if p == 1 else ""}
"""
    for p, src in ((1, "li"), (2, "f1u"))
)


def oracle_sql() -> dict[str, str]:
    title = lambda column, alias: q(f"SELECT item, {column} AS {alias} FROM items", ITEMS)
    both = "clean_title || CASE WHEN item % 3 <> 0 THEN ' (' || year || ')' ELSE ' ()' END"
    form = r"'(?s)^(.*?)\s*\((\d{4})\)\s*$'"
    obs = _held()
    return {
        "z_scores": q('SELECT "user", item, round(z, 6) AS z FROM z', EV, Z),
        "user_stats": q('SELECT "user", count(*) AS n, round(avg(rating), 6) AS mean, round(stddev_pop(rating), 6) AS sigma_raw, round(greatest(stddev_pop(rating), 0.5e0), 6) AS sigma FROM ev GROUP BY 1', EV),
        "two_pass_filter": q('SELECT "user", item, rating FROM f2u', LI, _FILTERED),
        "dense_index": q('SELECT CAST(dense_rank() OVER (ORDER BY "user") - 1 AS INTEGER) AS user_idx, CAST(dense_rank() OVER (ORDER BY item) - 1 AS INTEGER) AS item_idx, rating FROM f2u', LI, _FILTERED),
        "item_stats": q("SELECT item, clean_title, coalesce(n_ratings, 0) AS n_ratings, round(mean_rating, 6) AS mean_rating FROM catalogue LEFT JOIN li_stats USING (item)", LI, LI_STATS, CATALOGUE),
        "consensus_z": q("SELECT item, count(*) AS n, round(avg(z) * count(*) / (count(*) + 30.0e0), 6) AS z_mean FROM z GROUP BY item", EV, Z),
        "popularity_quintiles": q("SELECT item, n_ratings, 'Q' || CAST(1 + len(list_filter((SELECT quantile_cont(n_ratings, [0.2, 0.4, 0.6, 0.8]) FROM li_stats), lambda c: c <= n_ratings)) AS VARCHAR) AS quintile FROM li_stats", LI, LI_STATS),
        "pair_similarity": q("SELECT i, j, round(sim, 6) AS sim, n_co FROM half", EV, Z, half()),
        "pair_similarity_centered": q("SELECT i, j, round(sim, 6) AS sim, n_co FROM half", EV, Z, half(centered=True)),
        "topk_neighbours": q("SELECT i, j, round(sim, 6) AS sim, n_co FROM edges", EV, Z, half(), edges()),
        "topk_neighbours_sparse": q("SELECT i, j, round(sim, 6) AS sim, n_co FROM edges", LI, Z.replace("FROM ev", "FROM li"), half(lam=2.0), edges(200)),
        "similarity_excluding_users": q("SELECT i, j, round(sim, 6) AS sim, n_co FROM edges", *HELD_EDGES),
        "nearest_neighbours": q("SELECT i, CAST(place AS INTEGER) AS place, j, round(sim, 6) AS sim, clean_title FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j) AS place FROM edges) JOIN items ON items.item = j WHERE place <= 8", EV, Z, half(), edges(), ITEMS),
        "score_residual": _score_query(),
        "score_legacy": _score_query(residual=False, rank_k=0.0),
        "score_pred_shrink": _score_query(pred_k=3.0, floor=0.5, beta=0.5),
        "recommend_balanced": _recommend(0.15),
        "recommend_gem": _recommend(0.4, floor=0.01, most=3000),
        "recommend_blindspot": _recommend(0.0, least=60),
        "recommend_unfiltered": _recommend(0.15, filters=False),
        "explain": q('SELECT "user", candidate, item, round(contribution, 6) AS contribution, CAST(place AS INTEGER) AS place FROM why', *BUILD, RATED, scores(every=False), 'top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(rank_score, 9) DESC, item) AS r FROM scores WHERE scoreable) WHERE r <= 3)', _why(5, "top")),
        "predicted_stars": q('SELECT "user", item, round(greatest(0.5e0, least(5.0e0, mean + sigma * 1.17e0 * pred_z)), 6) AS stars, round(greatest(0.5e0, least(5.0e0, mean + sigma * z_mean)), 6) AS crowd FROM scores JOIN (SELECT "user", avg(rating) AS mean, greatest(stddev_pop(rating), 0.5e0) AS sigma FROM rated GROUP BY 1) USING ("user") WHERE scoreable', *BUILD, RATED, scores()),
        "leave_one_out": q('SELECT "user", target, CAST(rank AS INTEGER) AS rank, candidates FROM (SELECT *, row_number() OVER (PARTITION BY "user", target ORDER BY round(rank_score, 9) DESC NULLS LAST, item) AS rank, count(*) OVER (PARTITION BY "user", target) AS candidates FROM scores) WHERE item = target', *BUILD, RATED, 'best AS (SELECT "user", item AS target FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY rating DESC, item) AS r FROM rated) WHERE r = 1)', 'others AS (SELECT "user", target, item, z FROM rated JOIN best USING ("user") WHERE item <> target)', scores("others", ('"user"', "target"))),
        "norm_title": f"SELECT doc_id, {norm('text')} AS key FROM documents",
        "title_variants": title(f"array_to_string({variants('clean_title')}, '|')", "variants"),
        "title_year_split": q(f"SELECT item, CASE WHEN regexp_extract(t, {form}, 2) <> '' THEN regexp_extract(t, {form}, 1) ELSE t END AS title, CAST(nullif(regexp_extract(t, {form}, 2), '') AS INTEGER) AS title_year FROM (SELECT item, {strip(both)} AS t FROM items)", ITEMS),
        "display_title": title(shown("clean_title"), "shown"),
        "work_key": title(work("clean_title", "year"), "work"),
        "series_key": title(series("clean_title"), "series"),
        "base_titles": title(f"array_to_string({bases('clean_title')}, '|')", "bases"),
        "title_search": q("SELECT item, clean_title FROM items WHERE contains(lower(clean_title), 'widget (')", ITEMS),
        "match_exact": q("SELECT film_id, item, item_year, method FROM exact", *MATCHING),
        "match_legacy": q("SELECT film_id, item, item_year, method FROM exact", CATALOGUE, INDEX, FILMS, ASKED, _exact(0, False)),
        "match_fuzzy": q("SELECT film_id, item, item_year, method FROM fuzzy", *MATCHING, FUZZY),
        "match_films": q("SELECT film_id, item, item_year, method, n_ratings, round(mean_rating, 6) AS mean_rating, round(residual, 6) AS residual FROM matched", *MATCHING, FUZZY, LI, LI_STATS, MATCHED),
        "match_report": q("SELECT coalesce(method, 'unmatched') AS method, count(*) AS n, round(count(*) / (SELECT count(*) FROM films), 6) AS share FROM matched GROUP BY 1", *MATCHING, FUZZY, LI, LI_STATS, MATCHED),
        "coverage_after": q("SELECT count(*) FILTER (WHERE year >= 1995) AS n, round(count(*) FILTER (WHERE year >= 1995) / count(*), 6) AS share FROM films", FILMS),
        "profile_films": q('SELECT "user", title, year, rating, round(z + CASE WHEN is_liked THEN 0.25e0 ELSE 0 END, 6) AS z, round(weight, 6) AS weight, is_liked, has_review FROM pfilms', MEMBERS, PROFILE),
        "profile_stats": q('SELECT "user", n, round(mean, 6) AS mean, round(sigma_raw, 6) AS sigma_raw, round(sigma, 6) AS sigma, reference_date, CAST(sigma_raw < 0.5 AS BIGINT) + CAST(reference_date IS NULL AS BIGINT) + CAST(coalesce(top_share > 0.25, false) AS BIGINT) AS n_warnings FROM pstats LEFT JOIN busy USING ("user")', MEMBERS, PROFILE),
        "recency_weight": q('SELECT "user", ord, round(pow(0.5e0, date_diff(\'day\', logged_date, max(logged_date) OVER (PARTITION BY "user")) * 86400 / 31557600.0e0 / 3.0e0), 6) AS weight FROM members WHERE logged_date IS NOT NULL', MEMBERS),
        "bulk_import": q('SELECT "user", arg_min(d, (-n, d)) AS busiest, round(max(n) / sum(n), 6) AS top_share, max(n) / sum(n) > 0.25e0 AS bulk FROM (SELECT "user", logged_date AS d, count(*) AS n FROM members WHERE logged_date IS NOT NULL GROUP BY 1, 2) GROUP BY 1', MEMBERS),
        "liked_reviewed": q('SELECT "user", count(*) FILTER (WHERE is_liked) AS liked, count(*) FILTER (WHERE has_review) AS reviewed FROM pfilms GROUP BY 1', MEMBERS, PROFILE),
        "seen_union": q('SELECT DISTINCT "user", title, year FROM members', MEMBERS),
        "export_summary": q("SELECT count(*) AS n, count(DISTINCT title) AS n_titles, round(avg(rating), 6) AS rating_mean, round(stddev_samp(rating), 6) AS rating_stdev, min(rating) AS rating_min, max(rating) AS rating_max FROM members", MEMBERS),
        "type_filter": q("SELECT c.item, t.title_type FROM catalogue c LEFT JOIN (SELECT item, title_type FROM catalogue WHERE item % 3 <> 0) t USING (item) WHERE t.title_type IS NULL OR t.title_type NOT IN ('ECONOMY', 'PROMO', 'SMALL')", CATALOGUE),
        "only_shorts": q("SELECT item FROM catalogue WHERE title_type = 'SMALL'", CATALOGUE),
        "popularity_window": q("SELECT item, n_ratings FROM li_stats WHERE n_ratings BETWEEN 25 AND 35", LI, LI_STATS),
        "diversify": q(
            """SELECT "user", item FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY rank, item) AS n FROM k2) WHERE n <= 25""",
            ITEMS,
            f"""ranked AS (SELECT *, md5("user" || ':' || item) AS rank FROM (SELECT *, {work("clean_title", "year")} AS work, {series("clean_title")} AS series, {bases("clean_title")} AS bases FROM items) CROSS JOIN (SELECT unnest(range(3)) AS "user"))""",
            """started AS (SELECT DISTINCT "user", unnest(bases) AS base FROM ranked WHERE rank < '02')""",
            """parted AS (SELECT "user", item, unnest(bases) AS base FROM ranked WHERE work LIKE 'work::%')""",
            """gone AS (SELECT DISTINCT p."user", p.item FROM parted p JOIN started s ON p."user" = s."user" AND p.base = s.base)""",
            """k1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user", work ORDER BY rank, item) AS a FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g."user" = r."user" AND g.item = r.item)) WHERE a = 1)""",
            """k2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user", series ORDER BY rank, item) AS b FROM k1) WHERE series IS NULL OR b <= 2)""",
        ),
        "eval_users": q('SELECT "user" FROM hold', EV, HOLD),
        "holdout_split": q('SELECT "user", split, item, test FROM halves', EV, Z, _split("")),
        "baselines": q('SELECT "user", split, item, method, quintile, CAST(rank AS INTEGER) AS rank, candidates, round(percentile, 6) AS percentile, scoreable FROM obs', *EVALUATED, *obs),
        "ranking_metrics": q(_metrics(), *EVALUATED, *obs),
        "rating_error": q('SELECT "user", split, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(mean - rating)), 6) AS mae_trivial FROM (SELECT r.*, mean, greatest(0.5e0, least(5.0e0, mean + sigma * 1.17e0 * pred_z)) - rating AS e FROM ranked r JOIN (SELECT "user", avg(rating) AS mean, greatest(stddev_pop(rating), 0.5e0) AS sigma FROM ev GROUP BY 1) USING ("user") WHERE rating IS NOT NULL AND scoreable) GROUP BY 1, 2', *EVALUATED, *obs),
        "strata": q('SELECT "user", method, quintile, CAST(sum(n) AS BIGINT) AS n, round(sum(m * n) / sum(n), 6) AS median_percentile FROM (SELECT "user", split, method, quintile, count(*) AS n, median(percentile) AS m FROM obs GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3', *EVALUATED, *obs),
        "split_average": q('SELECT "user", method, quintile, round(sum(m) / 2.0e0, 6) AS median_percentile FROM (SELECT "user", split, method, quintile, median(percentile) AS m FROM obs GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3', *EVALUATED, *obs),
        "pooled_table": q(_table("obs"), *EVALUATED, *obs),
        "pooled_table_rankable": q(_table("obs", "scoreable"), *EVALUATED, *_held(floor=RANKABLE_FLOOR)),
        "config_sweep": _swept(SWEEP),
        "config_compare": _swept(COMPARE),
        "pooled_error": q('SELECT round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(mae_trivial), 6) AS mae_trivial, count(*) AS users FROM (SELECT "user", avg(mae) AS mae, avg(rmse) AS rmse, avg(mae_trivial) AS mae_trivial FROM (SELECT "user", split, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(abs(mean - rating)) AS mae_trivial FROM (SELECT r.*, mean, greatest(0.5e0, least(5.0e0, mean + sigma * 1.17e0 * pred_z)) - rating AS e FROM ranked r JOIN (SELECT "user", avg(rating) AS mean, greatest(stddev_pop(rating), 0.5e0) AS sigma FROM ev GROUP BY 1) USING ("user") WHERE rating IS NOT NULL AND scoreable) GROUP BY 1, 2) GROUP BY 1)', *EVALUATED, *obs),
        "sections": _sections(),
        "filter_counters": q(f"""SELECT k."user", k.watched, coalesce(c.ranked, 0) AS ranked, coalesce(c.non_films, 0) AS non_films, coalesce(c.weak, 0) AS weak FROM (SELECT "user", count(DISTINCT item) AS watched FROM rated GROUP BY 1) k
  LEFT JOIN (SELECT "user", count(*) AS ranked, count(*) FILTER (WHERE denied) AS non_films, count(*) FILTER (WHERE NOT denied AND (pred_z < 0 OR n_neighbours < 2)) AS weak
  FROM (SELECT s.*, coalesce({_DENIED}, false) AS denied FROM scores s JOIN items USING (item) WHERE scoreable) GROUP BY 1) c USING ("user")""", *BUILD, RATED, ITEMS, scores(every=False)),
        "title_neighbours": q(f"""SELECT CAST(place AS INTEGER) AS place, round(sim, 6) AS sim, j AS item, clean_title FROM (SELECT *, row_number() OVER (ORDER BY round(sim, 9) DESC, j) AS place FROM edges
  WHERE i = (SELECT item FROM items JOIN stats USING (item) WHERE contains(lower(clean_title), 'widget') ORDER BY n_ratings DESC, item LIMIT 1)) JOIN items ON items.item = j WHERE place <= 10 AND NOT coalesce({_DENIED}, false)""", *BUILD, ITEMS),
        "smoke_neighbours": q("SELECT i AS probe, j AS item, round(sim, 6) AS sim, clean_title FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j) AS place FROM edges WHERE i IN (1, 2, 3)) LEFT JOIN items ON items.item = j WHERE place <= 8", *HELD_EDGES, ITEMS),
        "top_consensus": q("SELECT CAST(place AS INTEGER) AS place, item, clean_title, n_ratings, round(z_mean, 6) AS z_mean FROM (SELECT *, row_number() OVER (ORDER BY round(z_mean, 9) DESC, item) AS place FROM stats) LEFT JOIN items USING (item) WHERE place <= 5", EV, Z, STATS, ITEMS),
        "fact_summary": q('SELECT count(*) AS ratings, count(DISTINCT "user") AS users, count(DISTINCT item) AS items FROM li', LI),
        "watchlist_match": q("\nUNION ALL ".join(f"SELECT '{name}' AS \"table\", coalesce(method, 'unmatched') AS method, count(*) AS n, round(count(*) / (SELECT count(*) FROM films WHERE {where}), 6) AS share FROM matched WHERE {where} GROUP BY 2" for name, where in (("rated", "true"), ("watchlist", "film_id % 4 = 0"))), *MATCHING, FUZZY, LI, LI_STATS, MATCHED),
        "profile_line": q("SELECT count(*) AS rated, count(m.item) AS matched, round(count(m.item) / count(*), 6) AS share, round(avg(f.rating), 6) AS mean, round(stddev_pop(f.rating), 6) AS spread, " + ", ".join(f"(SELECT string_agg(title[:30], ' · ' ORDER BY rating {order}, film_id) FROM (SELECT * FROM films ORDER BY rating {order}, film_id LIMIT 3)) AS {name}" for name, order in (("loved", "DESC"), ("hated", "ASC"))) + " FROM films f LEFT JOIN matched m USING (film_id)", *MATCHING, FUZZY, LI, LI_STATS, MATCHED),
        "profile_extremes": q("\nUNION ALL ".join(f"""SELECT "user", '{side}' AS side, CAST(k AS INTEGER) AS place, title, year, rating, round(z, 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(z, 9) {order}, ord) AS k FROM aged) WHERE k <= 3""" for side, order in (("loved", "DESC"), ("hated", "ASC"))), MEMBERS, PROFILE),
        "perfect_films": q("""SELECT "user", CAST(k AS INTEGER) AS place, title, year, rating FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ord) AS k FROM latest WHERE rating = 5.0) WHERE k <= 6""", MEMBERS, PROFILE),
        "profile_summary": q("""SELECT s."user", s.n, round(mean, 6) AS mean, round(sigma_raw, 6) AS sigma_raw, round(sigma, 6) AS sigma, reference_date, CAST(sigma_raw < 0.5 AS BIGINT) + CAST(reference_date IS NULL AS BIGINT) + CAST(coalesce(top_share > 0.25, false) AS BIGINT) AS n_warnings,
  reviewed, liked, round(weight_min, 6) AS weight_min, round(weight_median, 6) AS weight_median, round(weight_max, 6) AS weight_max FROM pstats s LEFT JOIN busy USING ("user")
  LEFT JOIN (SELECT "user", count(*) FILTER (WHERE has_review) AS reviewed, count(*) FILTER (WHERE is_liked) AS liked, min(weight) AS weight_min, median(weight) AS weight_median, max(weight) AS weight_max FROM pfilms GROUP BY 1) f USING ("user")""", MEMBERS, PROFILE),
        "streaming_item_stats": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, count(*) AS n_events, round(avg(value), 6) AS mean_value, max(ts) AS last_ts FROM events GROUP BY 1",
    }
