"""Registered queries of choices among candidates by ordered rules, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import corners
from ..functions import geometry as g
from ..operators import coordinates as co
from ..operators import rescues
from .queries import register, table

C = F.col
SCALE = 500.0


def _gap(a: str, b: str) -> str:
    """SQL of the largest corner distance."""
    return "greatest(" + ", ".join(f"sqrt(({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}]) + ({a}[{i + 1}] - {b}[{i + 1}]) * ({a}[{i + 1}] - {b}[{i + 1}]))" for i in (1, 3, 5, 7)) + f") / {SCALE}"


# Vectors as candidates: one of four shapes by id, shifted by the vector; every image's first three vectors give its outside proposals too.
SHAPES = ((30, 20, 370, 280), (18, 14, 382, 286), (125, 105, 275, 195), (31, 20, 371, 280))
CHOICE_SQL = f"""
    v AS (SELECT concat_ws('/', label::VARCHAR, (vec_id // 40)::VARCHAR) AS image, vec_id AS k, floor(abs(embedding[1]::DOUBLE) * 1000)::BIGINT % 4 AS d, floor(abs(embedding[2]::DOUBLE) * 1000)::BIGINT AS h FROM embeddings),
    s AS (SELECT *, CASE h % 4 {" ".join(f"WHEN {i} THEN {list(map(float, s))}::DOUBLE[]" for i, s in enumerate(SHAPES))} END AS b FROM v),
    t AS (SELECT image, k, h, lpad(k::VARCHAR, 10, '0') AS id, [b[1] + d, b[2], b[3] + d, b[2], b[3], b[4] + d, b[1], b[4]] AS c, (h % 7) / 10.0::DOUBLE AS score, 0.3::DOUBLE + (h % 4) / 20.0::DOUBLE AS ext, (h % 3) / 20.0::DOUBLE AS prior,
        CASE WHEN k % 5 = 0 THEN NULL ELSE list_distinct(['s' || k % 3, 's' || h % 5]) END AS seeds, CASE WHEN h % 11 = 0 THEN ['g0', 'g1'] ELSE ['g' || h % 2] END AS groups FROM s),
    e AS (SELECT image, k, id, c, score, ext, prior, coalesce(seeds, [id || ':implicit-seed:0']) AS seeds, groups, row_number() OVER (PARTITION BY image ORDER BY score DESC, id) AS r FROM t),
    n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY k) AS n FROM t),
    peer AS (SELECT image, 'p' || id AS id, c, score, ext + 0.1::DOUBLE AS ext, prior, coalesce(seeds, ['p' || id || ':implicit-seed:0']) AS seeds, groups FROM n WHERE n = 1 AND h % 5 > 0),
    mask AS (SELECT n.image, 'm' || id AS id, CASE WHEN h % 2 = 0 THEN list_transform(f.c, lambda x: x + 1) ELSE n.c END AS c, score, ext, prior, coalesce(seeds, ['m' || id || ':implicit-seed:0']) AS seeds, groups
        FROM n JOIN (SELECT image, c FROM n WHERE n = 1) f USING (image) WHERE n.n = 2)"""


def choice_sql() -> str:
    m = rescues.Limits()
    weak = lambda s, g: f"({s} < {m.seeds} OR {g} < {m.groups})"
    order = "ORDER BY g DESC, s DESC, ext DESC, score DESC, id"
    pick = "id, c, score, ext, prior, seeds, groups"
    packed = "{'id': id, 'c': c, 'score': score, 'ext': ext, 'prior': prior, 'seeds': seeds, 'groups': groups}"
    far = lambda a: f"list_distinct([m.k for m in w.members if {_gap('m.c', a)} > {m.cluster}])"
    return f"""WITH RECURSIVE {CHOICE_SQL.strip()},
    w AS (SELECT DISTINCT image, 0::BIGINT AS r, []::STRUCT(k BIGINT, c DOUBLE[])[] AS members, -1::BIGINT AS cluster FROM e UNION ALL
        SELECT image, r, list_append(members, {{'k': cluster, 'c': c}}), cluster FROM (SELECT e.image, e.r, w.members, e.c, list_min([x for x in range(0, len(w.members) + 1) if NOT list_contains({far('e.c')}, x)]) AS cluster FROM w JOIN e ON e.image = w.image AND e.r = w.r + 1)),
    u AS (SELECT image, w.cluster, len(list_distinct(flatten(list(seeds)))) AS s, len(list_distinct(flatten(list(groups)))) AS g, min(r) AS r FROM e JOIN w USING (image, r) GROUP BY ALL),
    b AS (SELECT e.image, {packed} AS x, e.ext AS base_ext, {weak('len(seeds)', 'len(groups)')} AS weak, {weak('u.s', 'u.g')} AS cluster_weak FROM e JOIN u ON u.image = e.image AND u.cluster = 0 WHERE e.r = 1),
    one AS (SELECT e.image, first({packed} {order.replace('g DESC, s', 'len(groups) DESC, len(seeds)')}) AS x FROM e JOIN b USING (image) WHERE NOT {weak('len(seeds)', 'len(groups)')} AND e.ext + {m.tolerance} >= b.base_ext GROUP BY 1),
    two AS (SELECT u.image, first({packed} {order}) AS x FROM u JOIN e USING (image, r) JOIN b USING (image) WHERE NOT {weak('u.s', 'u.g')} AND e.ext + {m.tolerance} >= b.base_ext GROUP BY 1),
    p AS (SELECT image, {packed} AS x FROM peer), q AS (SELECT image, {packed} AS x FROM mask),
    near AS (SELECT e.image, first({packed} ORDER BY {_gap('e.c', 'p.x.c')}, e.id) AS x FROM e JOIN p USING (image) GROUP BY 1),
    a0 AS (SELECT image, b.x AS base, p.x AS p, q.x AS q, near.x AS near, CASE WHEN b.weak AND one.x IS NOT NULL THEN one.x WHEN cluster_weak AND two.x IS NOT NULL THEN two.x ELSE b.x END AS x,
        CASE WHEN b.weak AND one.x IS NOT NULL THEN '{rescues.SUPPORTED}' WHEN cluster_weak AND two.x IS NOT NULL THEN '{rescues.UNITED}' ELSE '{rescues.BASE}' END AS reason FROM b LEFT JOIN one USING (image) LEFT JOIN two USING (image) LEFT JOIN p USING (image) LEFT JOIN q USING (image) LEFT JOIN near USING (image)),
    a1 AS (SELECT *, {_gap('x.c', 'p.c')} AS xp, {_gap('near.c', 'p.c')} AS np FROM a0),
    a2 AS (SELECT * EXCLUDE (x, reason, xp, np), CASE WHEN hit THEN near ELSE x END AS x, CASE WHEN hit THEN '{rescues.NEAREST}' ELSE reason END AS reason FROM (SELECT *, p IS NOT NULL AND xp >= {m.apart} AND np <= {m.agree} AND xp >= {m.agree_ratio} * greatest(np, 1e-6) AS hit FROM a1)),
    a3 AS (SELECT *, {_gap('x.c', 'p.c')} AS xp, {_gap('x.c', 'q.c')} AS xq, {_gap('p.c', 'q.c')} AS pq FROM a2),
    a4 AS (SELECT *, p IS NOT NULL AND q IS NOT NULL AND pq <= {m.outside_agree} AND least(xp, xq) >= {m.outside_ratio} * greatest(pq, 1e-6) AND p.ext - x.ext >= {m.advantage} AS peered,
        p IS NOT NULL AND q IS NOT NULL AND xq <= {m.mask_agree} AND least(xp, pq) >= {m.mask_ratio} * greatest(xq, 1e-6) AND x.prior <= {m.most_prior} AS masked FROM a3),
    a AS (SELECT image, base.id AS base, CASE WHEN peered THEN p WHEN masked THEN q ELSE x END AS x, CASE WHEN peered THEN '{rescues.PEER_AGREES}' WHEN masked THEN '{rescues.MASK_AGREES}' ELSE reason END AS reason FROM a4),
    z AS (SELECT image, 0::BIGINT AS r, [x.c] AS members, [x.id] AS ids FROM a UNION ALL
        SELECT e.image, e.r, CASE WHEN ok THEN list_append(members, e.c) ELSE members END, CASE WHEN ok THEN list_append(ids, e.id) ELSE ids END
        FROM (SELECT e.image, e.r, e.c, e.id, z.members, z.ids, NOT list_contains(z.ids, e.id) AND len([1 for m in z.members if {_gap('m', 'e.c')} > {m.cluster}]) = 0 AS ok FROM z JOIN e ON e.image = z.image AND e.r = z.r + 1) e),
    y AS (SELECT image, arg_max(ids, r) AS ids FROM z GROUP BY 1),
    f AS (SELECT image, list_distinct(flatten(list(e.seeds))) AS seeds, list_distinct(flatten(list(e.groups))) AS groups FROM y JOIN e USING (image) WHERE list_contains(ids, e.id) GROUP BY 1),
    o AS (SELECT image, first({packed} ORDER BY r) AS x FROM y JOIN e USING (image) WHERE NOT list_contains(ids, e.id) GROUP BY 1)
    SELECT image, a.x.id AS candidate, a.x.score AS score, reason, base, o.x.id AS rival, round({_gap('o.x.c', 'a.x.c')}, 9) AS rival_distance, round(a.x.score - o.x.score, 9) AS margin, len(ids)::INTEGER AS size,
        len(list_distinct(list_concat(a.x.seeds, coalesce(f.seeds, []))))::INTEGER AS seeds, len(list_distinct(list_concat(a.x.groups, coalesce(f.groups, []))))::INTEGER AS groups
    FROM a JOIN y USING (image) LEFT JOIN f USING (image) LEFT JOIN o USING (image)"""


@register("rescued_choice", choice_sql())
def rescued_choice(spark: SparkSession, d: str) -> DataFrame:
    """The candidate of each image that the chain of rescues leaves, why, and its rival."""
    k, shift = C("vec_id"), F.floor(F.abs(C("embedding")[0].cast("double")) * 1000) % 4
    h = F.floor(F.abs(C("embedding")[1].cast("double")) * 1000)
    image = F.concat_ws("/", C("label").cast("string"), F.floor(k / 40).cast("string"))
    shapes = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in SHAPES])
    rows = table(spark, d, "embeddings").select(image.alias("image"), k.alias("k"), h.alias("h"), shift.alias("d"), F.get(shapes, (h % 4).cast("int")).alias("b"))
    b, s = C("b"), C("d")
    name = F.lpad(C("k").cast("string"), 10, "0")
    text = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    share = lambda n, of: (C("h") % n).cast("double") / of
    edges = rows.select(
        "image", "k", "h", name.alias("candidate"), F.array(b[0] + s, b[1], b[2] + s, b[1], b[2], b[3] + s, b[0], b[3]).alias("corners"), share(7, 10.0).alias("score"), (0.3 + share(4, 20.0)).alias("exterior"), share(3, 20.0).alias("prior"),
        F.when(C("k") % 5 != 0, F.array_distinct(F.array(text("s", C("k") % 3), text("s", C("h") % 5)))).alias("seeds"), F.when(C("h") % 11 == 0, F.array(F.lit("g0"), F.lit("g1"))).otherwise(F.array(text("g", C("h") % 2))).alias("groups"),
    )
    # each image's vectors of least and next id, without a window over the image
    least = edges.groupBy("image").agg(F.min(F.struct("k", "h", "candidate", "corners", "score", "exterior", "prior", "seeds", "groups")).alias("one"))
    after = edges.join(least, "image").where("k > one.k").groupBy("image").agg(F.min(F.struct("k", "h", "candidate", "corners", "score", "exterior", "prior", "seeds", "groups")).alias("two"))
    pairs = least.join(after, "image", "left")

    def proposal(kind: str, letter: str, x: Column, corners: Column, more: float, when: Column) -> DataFrame:
        return pairs.where(when).select("image", F.lit(kind).alias("kind"), F.concat(F.lit(letter), x["candidate"]).alias("candidate"), corners.alias("corners"), x["score"].alias("score"), (x["exterior"] + more).alias("exterior"), x["prior"].alias("prior"), x["seeds"].alias("seeds"), x["groups"].alias("groups"))

    one, two = C("one"), C("two")
    moved = F.transform(one["corners"], lambda x: x + 1)
    outside = proposal("v7", "p", one, one["corners"], 0.1, one["h"] % 5 > 0).unionByName(proposal("mask", "m", two, F.when(two["h"] % 2 == 0, moved).otherwise(two["corners"]), 0.0, two.isNotNull()))
    found = rescues.rescued_choice(edges.drop("k", "h"), outside, "image", "candidate", SCALE)
    return found.select("image", "candidate", "score", "reason", "base", "rival", F.round("rival_distance", 9).alias("rival_distance"), F.round("margin", 9).alias("margin"), "size", "seeds", "groups")


WIDTH, HEIGHT = 640, 480


def corners_sql() -> str:
    far = f"greatest(0, -x, x - {WIDTH - 1}) / {WIDTH}.0::DOUBLE + greatest(0, -y, y - {HEIGHT - 1}) / {HEIGHT}.0::DOUBLE"
    clamp = lambda v, n: f"trunc(greatest(0, least({n - 1}, {v})))"

    def inferred(source: str, share: float, condition: str, cut: str) -> str:
        return f"""(SELECT k, first({{'t': t, 'x': {clamp('x', WIDTH)}, 'y': {clamp('y', HEIGHT)}, 'c': s / 3 * {share}::DOUBLE * CASE WHEN v > 0 THEN 1 - least(2 * v, 0.3::DOUBLE) ELSE 1 END}} ORDER BY pos) AS o FROM (SELECT *, {far} AS v FROM
            (SELECT k, t, pos, {cut}(xs[(t + 1) % 4 + 1] + xs[(t + 3) % 4 + 1] - xs[(t + 2) % 4 + 1]) AS x, {cut}(ys[(t + 1) % 4 + 1] + ys[(t + 3) % 4 + 1] - ys[(t + 2) % 4 + 1]) AS y, cs[(t + 1) % 4 + 1] + cs[(t + 2) % 4 + 1] + cs[(t + 3) % 4 + 1] AS s
            FROM {source}, (VALUES (3, 0), (2, 1), (0, 2), (1, 3)) AS p(t, pos) WHERE cs[(t + 1) % 4 + 1] > 0.6 AND cs[(t + 2) % 4 + 1] > 0.6 AND cs[(t + 3) % 4 + 1] > 0.6 AND {condition})) WHERE v <= 0.1 GROUP BY k)"""

    put = lambda xs, v: f"[CASE WHEN i = o.t THEN o.{v} ELSE {xs}[i + 1] END for i in range(0, 4)]"
    step = lambda i, a: f"({a}s[({i} + 1) % 4 + 1] - {a}s[{i} % 4 + 1])"
    size = lambda i: f"sqrt({step(i, 'x')} * {step(i, 'x')} + {step(i, 'y')} * {step(i, 'y')})"
    angle = lambda i: f"degrees(acos(greatest(-1, least(1, ({step(i, 'x')} * {step(i + 1, 'x')} + {step(i, 'y')} * {step(i + 1, 'y')}) / nullif({size(i)} * {size(i + 1)}, 0)))))"
    upright = " AND ".join(f"coalesce({angle(i)} > 60 AND {angle(i)} < 120, false)" for i in range(4))
    return f"""WITH b AS (SELECT o_orderkey AS k, o_custkey AS u, [(o_custkey * (2 * i + 3) + o_orderkey // 16) % 11 / 10.0::DOUBLE for i in range(0, 4)] AS cs FROM orders),
    r AS (SELECT k, cs, [5 + k % 31 / 2.0::DOUBLE - 9, 590 + k % 59, 600 + k % 61, 12 + k % 43] AS x0, [7 + k % 29 - 12.5::DOUBLE, 10 + k % 41, 430 + k % 67, 450 + k % 37] AS y0, u FROM b),
    d AS (SELECT k, cs, [x0[i + 1] + CASE WHEN i = u % 4 THEN u % 173 ELSE 0 END for i in range(0, 4)] AS xs, [y0[i + 1] + CASE WHEN i = u % 4 THEN u % 97 * 4 ELSE 0 END for i in range(0, 4)] AS ys FROM r),
    e AS (SELECT d.*, o, coalesce(o.c > cs[o.t + 1] AND NOT (cs[1] > 0.6 AND cs[2] > 0.6 AND cs[3] > 0.6 AND cs[4] > 0.6), false) AS hit FROM d LEFT JOIN {inferred('d', 0.95, 'true', '')} USING (k)),
    f AS (SELECT k, CASE WHEN hit THEN {put('xs', 'x')} ELSE xs END AS xs, CASE WHEN hit THEN {put('ys', 'y')} ELSE ys END AS ys, CASE WHEN hit THEN {put('cs', 'c')} ELSE cs END AS cs, CASE WHEN hit THEN 'edges' WHEN cs[1] > 0.6 AND cs[2] > 0.6 AND cs[3] > 0.6 AND cs[4] > 0.6 THEN 'found' ELSE 'none' END AS how FROM e),
    g AS (SELECT *, how = 'found' OR how = 'edges' AND {upright} AS done FROM f),
    h AS (SELECT g.*, o, coalesce(NOT done AND o.c > cs[o.t + 1], false) AS hit FROM g LEFT JOIN {inferred('g', 0.9, 'NOT cs[t + 1] > 0.6', 'trunc')} USING (k)),
    j AS (SELECT k, CASE WHEN hit THEN {put('xs', 'x')} ELSE xs END AS xs, CASE WHEN hit THEN {put('ys', 'y')} ELSE ys END AS ys, CASE WHEN hit THEN {put('cs', 'c')} ELSE cs END AS cs, CASE WHEN hit THEN 'diagonal' WHEN how = 'edges' AND NOT done THEN 'unchecked' ELSE how END AS how FROM h)
    SELECT k AS o_orderkey, how, {", ".join(f"{clamp(f'{a}s[{i + 1}]', n)} AS {a}{i}" for i in range(4) for a, n in (('x', WIDTH), ('y', HEIGHT)))}, {", ".join(f"round(cs[{i + 1}], 9) AS c{i}" for i in range(4))} FROM j"""


@register("completed_corners", corners_sql())
def completed_corners(spark: SparkSession, d: str) -> DataFrame:
    """Orders as quads with a shifted corner and corners of little confidence, completed."""
    k, u = C("o_orderkey"), C("o_custkey")
    x0 = (5 + k % 31 / 2 - 9, 590 + k % 59, 600 + k % 61, 12 + k % 43)
    y0 = (7 + k % 29 - 12.5, 10 + k % 41, 430 + k % 67, 450 + k % 37)
    quad = F.array(*[g.point((x + F.when(u % 4 == i, u % 173).otherwise(0)).cast("double"), (y + F.when(u % 4 == i, u % 97 * 4).otherwise(0)).cast("double")) for i, (x, y) in enumerate(zip(x0, y0))])
    trust = F.array(*[(u * (2 * i + 3) + F.floor(k / 16)) % 11 / 10 for i in range(4)])
    rows = table(spark, d, "orders").select("o_orderkey", quad.alias("quad"), trust.alias("trust"))
    found = rows.select("o_orderkey", corners.completed(C("quad"), C("trust"), F.lit(WIDTH), F.lit(HEIGHT)).alias("c"))
    at = lambda i: C("c.corners")[i]
    return found.select("o_orderkey", "c.how", *[at(i)[a].alias(f"{a}{i}") for i in range(4) for a in ("x", "y")], *[F.round(C("c.confidences")[i], 9).alias(f"c{i}") for i in range(4)])


# Fixed values of the planted pictures: turned by 90 degrees, analysed at half their size.
TURN, BACK, TWICE = "[[0.0,-1.0,99.0],[1.0,0.0,0.0],[0.0,0.0,1.0]]", "[[0.0,1.0,0.0],[-1.0,0.0,99.0],[0.0,0.0,1.0]]", "[[2.0,0.0,0.0],[0.0,2.0,0.0],[0.0,0.0,1.0]]"


def provenance_sql() -> str:
    sha = lambda text: f"'sha256:' || sha256({text})"
    transform = f'{{"analysis_size":[100,200],"analysis_to_full_transform":{TWICE},"exif_orientation":6,"forward_transform":{TURN},"full_normalized_size":[200,400],"inverse_transform":{BACK},"original_size":[200,100],"source_sha256":"sha256:ab12"}}'
    ids = """'{"annotation_id":"a' || k || '",'"""
    run = """'"run_artifact_hash":"h' || k % 7 || '","run_id":"r' || k % 7 || '"'"""
    batch = """'"batch_id":"b' || k % 3 || '",'"""
    payload = """'{"analysis_size":[100,200],"annotation_id":"a' || k || '","coordinate_space":"' || space || '","corner_order":"%s","evidence":' || ev || ',"evidence_hash":"' || eh || '","exif_orientation":6,"full_normalized_size":[200,400],"image_id":"i' || k || '","original_size":[200,100],"schema_version":1,"source_sha256":"sha256:ab12","transform_hash":"' || th || '"}'""" % co.CORNER_ORDER
    return f"""WITH o AS (SELECT o_orderkey AS k, o_custkey % 5 AS v, 10 + o_custkey % 31 + CASE WHEN o_custkey % 13 = 0 THEN 300 ELSE 0 END AS x, o_custkey % 11 = 0 AS spoilt, o_orderstatus AS s FROM orders),
    d AS (SELECT *, CASE v WHEN 0 THEN '{co.IMPORTED}' WHEN 1 THEN '{co.CONFIRMED}' WHEN 2 THEN '{co.CLEAN_RUN}' END AS kind, CASE v WHEN 3 THEN 'ambiguous' WHEN 4 THEN 'stored_rule' END AS reason,
        {sha(f'''CASE v WHEN 0 THEN {ids} || '"annotation_provenance":{{"by":"' || s || '"}},' || {batch} || '"evidence_document_hash":"sha256:d",' || {run} || '}}'
        WHEN 1 THEN {ids} || {batch} || '"normalized_size":[200,400],"orientation_transform":"rotate",' || {run} || ',"source_original_size":[200,100]}}'
        WHEN 2 THEN {ids} || {batch} || '"full_normalized_size":[200,400],"git_commit":"c","opencv":"4","recorded_gui_size":[200,400],' || {run} || '}}' END''')} AS identity FROM o),
    e AS (SELECT *, CASE WHEN v = 0 THEN '{co.STORED}' WHEN v < 3 THEN '{co.FULL}' END AS space, '{{"identity":"' || identity || '","kind":"' || kind || '"}}' AS ev, {sha(f"'{transform}'")} AS th FROM d),
    p AS (SELECT *, {sha(payload)} AS provenance_id FROM (SELECT *, {sha('ev')} AS eh FROM e)),
    r AS (SELECT *, CASE WHEN provenance_id IS NULL THEN 'missing' WHEN spoilt THEN 'hash' WHEN x > 300 THEN 'bounds' END AS refused FROM p)
    SELECT k AS o_orderkey, space, reason, identity, provenance_id, refused, CASE WHEN refused IS NULL THEN CASE WHEN v = 0 THEN 2 * (99 - 10) ELSE x END END::DOUBLE AS x0, CASE WHEN refused IS NULL THEN CASE WHEN v = 0 THEN 2 * x ELSE 10 END END::DOUBLE AS y0 FROM r"""


@register("coordinate_provenance", provenance_sql())
def coordinate_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Orders as annotations: what their corners mean by the records, the sealed proof (some are spoilt afterwards), and the corners in the full picture."""
    k, u = C("o_orderkey"), C("o_custkey")
    v = u % 5
    name = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    sizes = lambda *n: F.array(*[F.lit(i) for i in n])
    matrix = lambda text: F.from_json(F.lit(text), "array<array<double>>")
    x = 10 + u % 31 + F.when(u % 13 == 0, 300).otherwise(0)
    run = F.struct(name("r", k % 7).alias("run_id"), name("b", k % 3).alias("batch_id"), name("h", k % 7).alias("run_artifact_hash"), F.lit(True).alias("git_available"), (v == 3).alias("git_dirty"), F.lit("c").alias("git_commit"), F.lit("4").alias("opencv"))
    image = F.struct(
        F.when(v != 1, name("r", k % 7)).alias("run_id"), name("i", k).alias("image_id"), (v == 0).alias("legacy_import"), F.when(v == 1, sizes(200, 100)).alias("source_original_size"),
        F.when(v == 1, sizes(200, 400)).alias("normalized_size"), F.when(v.isin(2, 3), sizes(200, 400)).alias("original_size"), F.when(v == 1, "rotate").alias("orientation_transform"),
    )
    rule = F.when(v.isin(0, 4), F.struct(F.lit(co.STORED).alias("coordinate_space"), F.when(v == 0, name("b", k % 3)).otherwise("other").alias("batch_id"), F.lit("sha256:d").alias("evidence_document_hash")))
    loaded = F.struct(
        F.lit("ab12").alias("source_sha256"), F.lit(6).alias("exif_orientation"), sizes(200, 100).alias("original_size"), sizes(200, 400).alias("full_normalized_size"), sizes(100, 200).alias("analysis_size"),
        F.lit("rotate").alias("orientation_transform"), matrix(TURN).alias("forward_transform"), matrix(BACK).alias("inverse_transform"), matrix(TWICE).alias("analysis_to_full_transform"),
    )
    # the corners' second x lies 20 to the right of the first
    quad = g.quad(x, F.lit(10), x + 20, F.lit(10), x + 20, F.lit(40), x, F.lit(40))
    rows = table(spark, d, "orders").select(
        k, (u % 11 == 0).alias("spoilt"), name("a", k).alias("annotation_id"), name("i", k).alias("image_id"), name("r", k % 7).alias("run_id"), F.to_json(F.struct(C("o_orderstatus").alias("by"))).alias("annotation_provenance"),
        quad.alias("boundary_corners"), run.alias("run"), image.alias("run_image"), rule.alias("rule"), loaded.alias("loaded"),
    )
    proven = co.sealed(co.decided(rows)).withColumn("provenance_id", C("provenance.provenance_id"))
    spoilt = proven.withColumn("provenance", F.when(C("spoilt") & C("provenance").isNotNull(), C("provenance").withField("exif_orientation", F.lit(1))).otherwise(C("provenance")))
    truth = C("truth")
    return co.resolved(spoilt).select("o_orderkey", C("coordinate_space").alias("space"), "reason", C("evidence.identity").alias("identity"), "provenance_id", "refused", truth[0]["x"].alias("x0"), truth[0]["y"].alias("y0"))
