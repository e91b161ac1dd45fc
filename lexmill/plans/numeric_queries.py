"""Generators, small models, and their one-step and closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import vectors as V
from lexmill.operators import numeric
from lexmill.plans.common import Registry, table

R = Registry()


def stream_sql(n: int, seed: int) -> str:
    return f"WITH RECURSIVE lcg(i, state) AS (SELECT CAST(0 AS BIGINT), CAST({seed} AS BIGINT) UNION ALL SELECT i+1, (1664525*state+1013904223)%4294967296 FROM lcg WHERE i<{n})"


@R.add("n1_lcg", stream_sql(1599, 7) + " SELECT i, state, round(state/4294967296.0,9) AS u FROM lcg WHERE i>0")
def _(s, d):
    return numeric.lcg(s, 1599, 7).withColumn("u", F.round("u", 9))


@R.add("n2_normals", stream_sql(400, 5) + ", u AS (SELECT (i-1)//2 AS k, max(CASE WHEN i%2=1 THEN state END)/4294967296.0 AS a, max(CASE WHEN i%2=0 THEN state END)/4294967296.0 AS b FROM lcg WHERE i>0 GROUP BY 1) SELECT k*2+j AS i, round(sqrt(-2*ln(greatest(a,1e-12)))*CASE WHEN j=1 THEN cos(2*pi()*b) ELSE sin(2*pi()*b) END,6) AS z FROM u, range(1,3) r(j)")
def _(s, d):
    return numeric.normals(s, 400, 5).withColumn("z", F.round("z", 6))


@R.add("n3_choices", stream_sql(500, 11) + " SELECT i, CAST(floor(state/4294967296.0*7) AS BIGINT) AS k FROM lcg WHERE i>0")
def _(s, d):
    return numeric.lcg(s, 500, 11).select("i", F.floor(F.col("u") * 7).cast("bigint").alias("k"))


#: Normal m, from 0, of the stream's pairs of uniforms.
NORMALS = ", u AS (SELECT (i-1)//2 AS k, max(CASE WHEN i%2=1 THEN state END)/4294967296.0 AS a, max(CASE WHEN i%2=0 THEN state END)/4294967296.0 AS b FROM lcg WHERE i>0 GROUP BY 1), z AS (SELECT k*2+j AS m, sqrt(-2*ln(greatest(a,1e-12)))*CASE WHEN j=0 THEN cos(2*pi()*b) ELSE sin(2*pi()*b) END AS z FROM u, range(2) r(j))"


@R.add("n4_layers", stream_sql(18, 5) + NORMALS + " SELECT CAST(m//4 AS INT) AS layer, CAST(CASE WHEN m<16 THEN m%4//2 ELSE m-16 END AS INT) AS i, CAST(CASE WHEN m<16 THEN m%2 ELSE 0 END AS INT) AS j, round(CASE WHEN m>=16 THEN 0.16*z WHEN m%4//2=m%2 THEN 1+0.02*z ELSE 0.02*z END,6) AS w FROM z")
def _(s, d):
    layers = numeric.new_layers([2, 2, 2, 2, 2, 1], numeric.Stream(5), 0.16, 0.16, True)
    return s.createDataFrame([(k, i, j, round(float(w[i, j]), 6)) for k, (w, _) in enumerate(layers) for i in range(w.shape[0]) for j in range(w.shape[1])], "layer int, i int, j int, w double")


def shuffle_sql(n: int, skip: int) -> str:
    """sh(k, xs): xs is the order of 0 to n-1 after a shuffle by the stream's draws beyond `skip`, where k is 0."""
    return f""", sh(k, xs) AS (SELECT {n - 1}, range({n}) UNION ALL SELECT k-1, list_transform(range(1,{n + 1}), lambda p: CASE WHEN p=k+1 THEN xs[j+1] WHEN p=j+1 THEN xs[k+1] ELSE xs[p] END)
 FROM (SELECT k, xs, CAST(floor(state/4294967296.0*(k+1)) AS BIGINT) AS j FROM sh JOIN lcg ON i={skip + n}-k WHERE k>0))"""


#: Two points take eight draws: an angle and two pairs of normals, an angle and a pair; the odd one's first is left over.
RINGS = stream_sql(1280 + 319, 7) + shuffle_sql(320, 1280) + """, u AS (SELECT (i-1)//8 AS m, list(state/4294967296.0 ORDER BY i) AS l FROM lcg WHERE i BETWEEN 1 AND 1280 GROUP BY 1),
z AS (SELECT m, l, list_transform([1,3,6], lambda p: sqrt(-2*ln(greatest(l[p+1],1e-12)))) AS g, list_transform([1,3,6], lambda p: 2*pi()*l[p+2]) AS a FROM u),
p AS (SELECT 2*m AS n, l[1] AS t, g[1]*cos(a[1]) AS z1, g[1]*sin(a[1]) AS z2, g[2]*cos(a[2]) AS z3 FROM z UNION ALL SELECT 2*m+1, l[6], g[2]*sin(a[2]), g[3]*cos(a[3]), g[3]*sin(a[3]) FROM z),
r AS (SELECT n, t, CASE WHEN n<160 THEN 0.72+0.08*z1 ELSE 1.55+0.10*z1 END AS r, z2, z3, CAST(CASE WHEN n<160 THEN 0 ELSE 1 END AS INT) AS label FROM p),
o AS (SELECT unnest(range(320)) AS i, unnest(xs) AS n FROM sh WHERE k=0)
SELECT o.i, round(r*cos(2*pi()*t)+0.025*z2,6) AS x, round(r*sin(2*pi()*t)+0.025*z3,6) AS y, label FROM o JOIN r USING (n)"""


@R.add("src9_rings", RINGS)
def _(s, d):
    return s.createDataFrame(numeric.ring_points(), "i long, x double, y double, label int").withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


NOISY = stream_sql(2400, 99) + """, u AS (SELECT (i-1)//3 AS r, max(CASE WHEN i%3=1 THEN state END)/4294967296.0 AS a, max(CASE WHEN i%3=2 THEN state END)/4294967296.0 AS b, max(CASE WHEN i%3=0 THEN state END)/4294967296.0 AS c FROM lcg WHERE i>0 GROUP BY 1),
pt AS (SELECT r AS i, -2+4*a AS x, -2+4*b AS y, c<0.08 AS flip FROM u), noisy AS (SELECT i, x, y, CAST((sin(2.8*x)+cos(2.2*y)+0.35*sin(3*x*y)>0)<>flip AS INT) AS label FROM pt)"""


@R.add("src10_noisy_points", NOISY + " SELECT i, round(x,7) AS x, round(y,7) AS y, label FROM noisy")
def _(s, d):
    return numeric.noisy_points(s, 800, 99).select("i", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"), "label")


@R.add("src11_toy_bigrams", stream_sql(5400, 21) + """, u AS (SELECT (i-1)//6 AS r, list(state/4294967296.0 ORDER BY i) AS l FROM lcg WHERE i>0 GROUP BY 1)
SELECT r*3+k AS i, CAST(CASE k WHEN 0 THEN floor(l[1]*3) WHEN 1 THEN 3+floor(l[3]*2) ELSE 5+floor(l[5]*3) END AS INT) AS input, CAST(CASE k WHEN 0 THEN 8+floor(l[2]*3) WHEN 1 THEN 11+floor(l[4]*3) ELSE floor(l[6]*5) END AS INT) AS target FROM u, range(3) q(k)""")
def _(s, d):
    return numeric.toy_bigrams(s)


GRID = "SELECT px, py FROM range(0,360,10) a(px), range(0,240,10) b(py)"


@R.add("src12_grid", GRID)
def _(s, d):
    return numeric.grid(s, 360, 240, 10)


#: A fixed affine model, scored on the grid; its 0.5 line is where neighbours differ in sign.
SCORE = "1/(1+exp(-greatest(-40,least(40, 0.7*(px/60.0-3)+1.1*(py/60.0-2)+0.05))))"


def _score(s):
    z = 0.7 * (F.col("px") / 60.0 - 3) + 1.1 * (F.col("py") / 60.0 - 2) + 0.05
    return numeric.grid(s, 360, 240, 10).withColumn("p", V.sigmoid(z))


@R.add("n12_n13_grid_scores", f"SELECT px, py, round({SCORE},6) AS p FROM ({GRID})")
def _(s, d):
    return _score(s).withColumn("p", F.round("p", 6))


@R.add("win4_contour", f"WITH g AS (SELECT px, py, {SCORE}-0.5 AS v FROM ({GRID})), l AS (SELECT *, lag(v) OVER (PARTITION BY py ORDER BY px) AS row_last, lag(v) OVER (PARTITION BY px ORDER BY py) AS col_last FROM g) SELECT px, py, row_last IS NOT NULL AND (row_last=0 OR v=0 OR row_last*v<0) AS by_row, col_last IS NOT NULL AND (col_last=0 OR v=0 OR col_last*v<0) AS by_col FROM l WHERE (row_last*v<=0) OR (col_last*v<=0)")
def _(s, d):
    g = _score(s).withColumn("v", F.col("p") - 0.5)
    g = g.withColumn("row_last", F.lag("v").over(Window.partitionBy("py").orderBy("px"))).withColumn("col_last", F.lag("v").over(Window.partitionBy("px").orderBy("py")))
    crossed = lambda c: F.coalesce(F.col(c) * F.col("v") <= 0, F.lit(False))
    return g.select("px", "py", crossed("row_last").alias("by_row"), crossed("col_last").alias("by_col")).where("by_row or by_col")


@R.add("agg21_bounds", NOISY + " SELECT round(min(x)-0.35,6) AS xmin, round(max(x)+0.35,6) AS xmax, round(min(y)-0.35,6) AS ymin, round(max(y)+0.35,6) AS ymax FROM noisy")
def _(s, d):
    n = numeric.noisy_points(s, 800, 99)
    return n.agg(*[F.round(f(c) + m, 6).alias(c + n_) for c in ("x", "y") for f, m, n_ in ((F.min, -0.35, "min"), (F.max, 0.35, "max"))])


@R.add("agg18_accuracy_loss", NOISY + ", p AS (SELECT label, greatest(1e-6,least(1-1e-6,1/(1+exp(-(0.3*x-0.2*y+0.1))))) AS p FROM noisy) SELECT round(avg(CAST((p>=0.5)=(label=1) AS INT)),6) AS accuracy, round(avg(-(label*ln(p)+(1-label)*ln(1-p))),6) AS loss FROM p")
def _(s, d):
    p = numeric.noisy_points(s, 800, 99).withColumn("p", V.sigmoid(0.3 * F.col("x") - 0.2 * F.col("y") + 0.1))
    return p.agg(F.round(F.avg(((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("int")), 6).alias("accuracy"), F.round(F.avg(V.log_loss(F.col("p"), F.col("label"))), 6).alias("loss"))


@R.add("agg19_n5_gradient_step", NOISY + ", g AS (SELECT avg((1/(1+exp(-(0.3*x-0.2*y+0.1)))-label)*x) AS dw0, avg((1/(1+exp(-(0.3*x-0.2*y+0.1)))-label)*y) AS dw1, avg(1/(1+exp(-(0.3*x-0.2*y+0.1)))-label) AS db FROM noisy) SELECT round(0.3-0.1*dw0,6) AS w0, round(-0.2-0.1*dw1,6) AS w1, round(0.1-0.1*db,6) AS b FROM g")
def _(s, d):
    n = numeric.noisy_points(s, 800, 99)
    e = V.sigmoid(0.3 * F.col("x") - 0.2 * F.col("y") + 0.1) - F.col("label")
    g = n.agg(F.avg(e * F.col("x")).alias("g0"), F.avg(e * F.col("y")).alias("g1"), F.avg(e).alias("gb"))
    return g.select(F.round(0.3 - 0.1 * F.col("g0"), 6).alias("w0"), F.round(-0.2 - 0.1 * F.col("g1"), 6).alias("w1"), F.round(0.1 - 0.1 * F.col("gb"), 6).alias("b"))


@R.add("n5_n6_ring_models")
def _(s, d):
    return numeric.ring_models(s)


#: Two small matrices as long tables, multiplied by join and sum.
MATS = "(VALUES (0,0,0,1.5),(0,0,1,-0.5),(0,1,0,0.25),(0,1,1,2.0),(1,0,0,0.5),(1,0,1,1.0),(1,1,0,-1.0),(1,1,1,0.75)) v(layer,i,j,w)"


@R.add("n7_collapse", f"SELECT a.i, b.j, CAST(sum(a.w*b.w) AS DOUBLE) AS w FROM {MATS} JOIN {MATS.replace('v(', 'b(')} ON v.layer=0 AND b.layer=1 AND v.j=b.i GROUP BY 1,2".replace("a.i", "v.i").replace("a.w", "v.w"))
def _(s, d):
    m = s.createDataFrame([(0, 0, 0, 1.5), (0, 0, 1, -0.5), (0, 1, 0, 0.25), (0, 1, 1, 2.0), (1, 0, 0, 0.5), (1, 0, 1, 1.0), (1, 1, 0, -1.0), (1, 1, 1, 0.75)], "layer int, i int, j int, w double")
    a = m.where("layer = 0").select("i", F.col("j").alias("k"), F.col("w").alias("x"))
    b = m.where("layer = 1").select(F.col("i").alias("k"), "j", F.col("w").alias("y"))
    return a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("w"))


@R.add("n8_toy_embeddings")
def _(s, d):
    return numeric.toy_embeddings(s)


@R.add("n10_toy_neighbours")
def _(s, d):
    e = numeric.toy_embeddings(s).where("id < 8")
    got = numeric.neighbours(e, e, 2, "id", "embedding")
    return got


@R.add("n11_n14_agg22_gap")
def _(s, d):
    return numeric.gap(s)


@R.add("srt7_shuffle", stream_sql(99, 3) + shuffle_sql(100, 0) + " SELECT CAST(unnest(range(100)) AS INT) AS place, CAST(unnest(xs) AS INT) AS item FROM sh WHERE k=0")
def _(s, d):
    order = list(range(100))
    numeric.Stream(3).shuffle(order)
    return s.createDataFrame(list(enumerate(order)), "place int, item int")
