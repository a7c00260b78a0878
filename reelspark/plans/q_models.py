"""Model queries: ALS, item2vec, user vectors, NCF, click model.

Random models cannot be value-hashed against SQL; these keys carry no oracle
(row check) and are covered by invariants in ``tests/test_models.py``. The
sequence table that feeds item2vec has an exact oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelspark.functions.columns import STRICT_LIKE_THRESHOLD, like_label, rounded
from reelspark.operators import als, indexing, item_vectors, ncf_training, requests, scoring, sequences, serving
from reelspark.operators.similarity import dense_cosine_pairs
from reelspark.plans.catalog import query
from reelspark.plans.oracle import with_views
from reelspark.session import checkpoint_dir
from reelspark.sources import driver_tables as src

NCF_TOP_N = 10
REQUEST_PAIRS = 25


@query("watch_sequences", "A10 P3 (liked items per user in time order)", with_views("""
select uid, cast(row_number() over (partition by uid order by ts, mid) - 1 as bigint) pos, mid
from ratings where score >= 3.5""", "ratings"))
def watch_sequences(spark, d):
    return sequences.watch_positions(src.ratings(spark, d))


def _item2vec(spark, d):
    r = src.ratings(spark, d)
    model = sequences.fit_item2vec(sequences.sentences(sequences.watch_positions(r)))
    return r, sequences.item_vectors(model)


@query("item2vec", "F10 (Word2Vec dim 10, window 5, 1 iteration)")
def item2vec(spark, d):
    return _item2vec(spark, d)[1]


@query("item2vec_topk", "F11 J9 Q10 (10 most similar items by item2vec vectors)")
def item2vec_topk(spark, d):
    top = dense_cosine_pairs(_item2vec(spark, d)[1], "mid", "vector", k=10, other_col="sim_mid")
    return top.select("mid", "rank", "sim_mid", rounded(F.col("score")).alias("score"))


@query("item2vec_blocks", "F10 F11 (skip-gram with negative sampling over partitioned tables; 10 most similar items)")
def item2vec_blocks(spark, d):
    v = item_vectors.fit_item_vectors(sequences.watch_positions(src.ratings(spark, d)))
    top = dense_cosine_pairs(v, "mid", "vector", k=10, other_col="sim_mid")
    return top.select("mid", "rank", "sim_mid", rounded(F.col("score")).alias("score"))


@query("user_vectors", "A13 J24 (sum of rated items' vectors)")
def user_vectors(spark, d):
    r, vec = _item2vec(spark, d)
    return sequences.user_vectors(r, vec)


@query("user_embedding_sum", "A13 J24 (user vector = sum of fixed item vectors; one row per dimension)",
       with_views("""
with uv as (
  select r.uid, u.pos - 1 dim, sum(cast(u.v as double)) value
  from ratings r join (select vec_id, unnest(embedding) v, generate_subscripts(embedding, 1) pos from embeddings) u
    on u.vec_id = r.mid
  group by r.uid, u.pos),
users_r as (select distinct uid from ratings),
dims as (select range dim from range((select max(len(embedding)) from embeddings)))
select a.uid, cast(d.dim as bigint) dim, round(coalesce(uv.value, 0.0), 6) value
from users_r a cross join dims d left join uv on uv.uid = a.uid and uv.dim = d.dim""", "ratings"))
def user_embedding_sum(spark, d):
    """The driver's fixed 64-float vectors stand in for item vectors (item id =
    vector id); items without a vector are skipped, users without any get zeros."""
    e = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("mid"),
                                                 F.col("embedding").cast("array<double>").alias("vector"))
    dim = e.agg(F.max(F.size("vector"))).first()[0]
    uv = sequences.user_vectors(src.ratings(spark, d), e, dim=dim)
    return uv.select("uid", F.posexplode("vector").alias("dim", "value")).select(
        "uid", F.col("dim").cast("bigint"), rounded(F.col("value")).alias("value"))


def als_model(spark, d):
    """The reference's model on all ratings, fitted once per application."""
    return als.written_once(lambda: src.ratings(spark, d), spark, d)


@query("als_user_recs", "F12 J7 T3 P10 (top-10 predicted items per user)")
def als_user_recs(spark, d):
    return als.user_recs(als_model(spark, d)).withColumn("score", rounded(F.col("score")))


@query("als_unseen_recs", "F12 T3 J16 (top-10 predicted items the user has not rated)")
def als_unseen_recs(spark, d):
    return als.user_recs(als_model(spark, d), seen=src.ratings(spark, d)).withColumn("score", rounded(F.col("score")))


@query("als_similar_items", "J9 F15 T5 (item factor cosine > 0.6, all partners)")
def als_similar_items(spark, d):
    return als.similar_items(als_model(spark, d)).withColumn("score", rounded(F.col("score")))


@query("als_similar_topn", "Q10 J9 T10 J21 (10 most similar items by ALS factors, with titles)")
def als_similar_topn(spark, d):
    pairs = als.similar_items(als_model(spark, d), k=10)
    top = pairs.select("mid", "rank", "sim_mid", rounded(F.col("score")).alias("score"))
    return serving.hydrate(top, src.items(spark, d).select("mid", "title"), "sim_mid", "mid")


@query("als_similar_users", "J8 F15 T4 Q9 (top-10 users by factor cosine > 0.6)")
def als_similar_users(spark, d):
    return als.similar_users(als_model(spark, d)).withColumn("score", rounded(F.col("score")))


@query("als_rmse", "F13 A14 J13 (hash 80/20 split, RMSE on the holdout)")
def als_rmse(spark, d):
    train, test = als.holdout_split(src.ratings(spark, d))
    return als.rmse_frame(als.written_once(lambda: train, spark, f"{d}#train"), test)


@query("als_grid", "F14 A15 (rank x lambda grid, arg-min RMSE)")
def als_grid(spark, d):
    train, test = als.holdout_split(src.ratings(spark, d))
    return als.grid_search(train, test)


# Factor tables by rule: what follows a fit can then be stated in SQL and compared by value.
RULE_RANK = 6


def rule_factors(spark, d):
    """Factors of every item with mid % 7 <> 0 and every user with uid % 5 <> 0."""
    def vector(key, salt):
        return F.array(*[F.sin(F.col(key) * (0.37 + 0.11 * j) + (1.7 * j + salt)) + 0.5 for j in range(RULE_RANK)])
    users = src.users(spark, d).where("uid % 5 <> 0").select("uid", vector("uid", 1).alias("features"))
    items = src.items(spark, d).where("mid % 7 <> 0").select("mid", vector("mid", 2).alias("features"))
    return als.Factors(users, items)


def _rule_sql(key, salt):
    return "[" + ", ".join(f"sin({key} * {0.37 + 0.11 * j!r}::double + {1.7 * j + salt!r}::double) + 0.5" for j in range(RULE_RANK)) + "]"


_DOT = "(" + " + ".join(f"u.f[{j}] * i.f[{j}]" for j in range(1, RULE_RANK + 1)) + ")"
_COS = ("(" + " + ".join(f"a.f[{j}] * b.f[{j}]" for j in range(1, RULE_RANK + 1)) + ") / sqrt((" + " + ".join(f"a.f[{j}] * a.f[{j}]" for j in range(1, RULE_RANK + 1))
        + ") * (" + " + ".join(f"b.f[{j}] * b.f[{j}]" for j in range(1, RULE_RANK + 1)) + "))")
RULE_CTES = {"uf": f"select uid, {_rule_sql('uid', 1)} f from users where uid % 5 <> 0",
             "itf": f"select mid, {_rule_sql('mid', 2)} f from items where mid % 7 <> 0"}
RULE_LISTS_SQL = f"""
select uid, mid, score, cast(row_number() over (partition by uid order by round(score, 9) desc, mid) as bigint) rank
from (select u.uid, i.mid, {_DOT} score from uf u cross join itf i
      where not exists (select 1 from ratings r where r.uid = u.uid and r.mid = i.mid)) t
where score > 0 qualify rank <= 10"""


@query("factor_recs", "T3 P10 J7 J16 (top-10 unseen items from fixed factor tables)",
       with_views(f"select uid, rank, mid, round(score, 6) score from ({RULE_LISTS_SQL}) x", "ratings", "users", "items", extra=RULE_CTES))
def factor_recs(spark, d):
    return als.user_recs(rule_factors(spark, d), seen=src.ratings(spark, d)).withColumn("score", rounded(F.col("score")))


@query("factor_similar_topn", "J9 T5 Q10 (10 most similar items from a fixed factor table)", with_views(f"""
select mid, rank, sim_mid, round(score, 6) score from (
  select mid, sim_mid, score, cast(row_number() over (partition by mid order by round(score, 9) desc, sim_mid) as bigint) rank
  from (select a.mid, b.mid sim_mid, {_COS} score from itf a join itf b on a.mid <> b.mid) s where score > 0.6) t where rank <= 10""", "items", extra=RULE_CTES))
def factor_similar_topn(spark, d):
    top = als.similar_items(rule_factors(spark, d), k=10)
    return top.select("mid", "rank", "sim_mid", rounded(F.col("score")).alias("score"))


@query("factor_rmse", "A14 J13 (RMSE of fixed factor tables over the ratings they cover)", with_views(f"""
select round(sqrt(avg((r.score - {_DOT}) * (r.score - {_DOT}))), 6) rmse, count(*) n_test
from ratings r join uf u on u.uid = r.uid join itf i on i.mid = r.mid""", "ratings", "users", "items", extra=RULE_CTES))
def factor_rmse(spark, d):
    return als.rmse_frame(rule_factors(spark, d), src.ratings(spark, d)).withColumn("rmse", rounded(F.col("rmse")))


def _ncf_inputs(spark, d):
    r = src.ratings(spark, d)
    uidx = indexing.dense_index(r, "uid", "user_idx")
    iidx = indexing.dense_index(src.items(spark, d), "mid", "item_idx")
    users, items = scoring.embedding_tables(uidx, iidx)
    seen = indexing.attach_index(indexing.attach_index(r, uidx, "uid"), iidx, "mid")
    return seen, users, items, uidx, iidx


NCF_SQL = """
with uidx as (select uid, row_number() over (order by uid) - 1 user_idx from (select distinct uid from ratings) t),
iidx as (select mid, row_number() over (order by mid) - 1 item_idx from (select distinct mid from items) t),
pairs as (select u.user_idx, i.item_idx from ratings r join uidx u on r.uid = u.uid join iidx i on r.mid = i.mid),
x as (select user_idx, item_idx, j,
             case when j < 8 then 0.1 * sin(0.7 * user_idx + (1.3 * j + 1))
                  else 0.1 * sin(0.7 * item_idx + (1.3 * (j - 8) + 3)) end v
      from pairs, range(16) t(j)),
w0 as (select o, i, sin(1 + 0.37 * o + 0.11 * i + 0) / sqrt(16) w from range(64) a(o), range(16) b(i)),
w1 as (select o, i, sin(1 + 0.37 * o + 0.11 * i + 1) / sqrt(64) w from range(32) a(o), range(64) b(i)),
w2 as (select o, i, sin(1 + 0.37 * o + 0.11 * i + 2) / sqrt(32) w from range(8) a(o), range(32) b(i)),
h1 as (select user_idx, item_idx, o j, greatest(sum(v * w) + 0.01 * cos(o + 0), 0) v
       from x join w0 on x.j = w0.i group by user_idx, item_idx, o),
h2 as (select user_idx, item_idx, o j, greatest(sum(v * w) + 0.01 * cos(o + 1), 0) v
       from h1 join w1 on h1.j = w1.i group by user_idx, item_idx, o),
h3 as (select user_idx, item_idx, o j, greatest(sum(v * w) + 0.01 * cos(o + 2), 0) v
       from h2 join w2 on h2.j = w2.i group by user_idx, item_idx, o),
g as (select user_idx, item_idx, j + 8 j,
             (0.1 * sin(0.7 * user_idx + (1.3 * j + 2))) * (0.1 * sin(0.7 * item_idx + (1.3 * j + 4))) v
      from pairs, range(8) t(j)),
z as (select user_idx, item_idx, sum(v * sin(0.5 + 0.23 * j) / sqrt(16)) z
      from (select * from h3 union all select * from g) u group by user_idx, item_idx)
select user_idx, item_idx, round(1 / (1 + exp(-z)), 6) score from z"""


@query("ncf_score", "F16 (NCF forward pass over every rated pair)", with_views(NCF_SQL, "ratings", "items"))
def ncf_score(spark, d):
    seen, users, items, _, _ = _ncf_inputs(spark, d)
    s = scoring.score_pairs(seen, users, items, scoring.init_layers())
    return s.withColumn("score", rounded(F.col("score")))


@query("ncf_requests", "JSON S17 F16 (scoring requests as JSON, their responses, candidates and scores matched by position)", with_views(f"""
select ui.uid, ii.mid, s.score from ({NCF_SQL}) s
join (select uid, row_number() over (order by uid) - 1 user_idx from (select distinct uid from ratings) t) ui using (user_idx)
join (select mid, row_number() over (order by mid) - 1 item_idx from (select distinct mid from items) t) ii using (item_idx)""", "ratings", "items"))
def ncf_requests(spark, d):
    """Every user's rated items go out as JSON requests, are scored from the
    JSON, and come back as JSON responses that are read again."""
    iidx = indexing.dense_index(src.items(spark, d), "mid", "item_idx")
    # written once: dealing them to ranges reads them twice
    path = f"{checkpoint_dir(spark).rstrip('/')}/candidates-{uuid.uuid4().hex}"
    indexing.attach_index(src.ratings(spark, d).select("uid", "mid"), iidx, "mid").write.parquet(path)
    lists = requests.candidate_lists(spark.read.parquet(path), REQUEST_PAIRS)
    uidx = indexing.dense_index(lists, "uid", "user_idx")
    users, items = scoring.embedding_tables(uidx, iidx)
    asked = requests.write_requests(indexing.attach_index(lists, uidx, "uid"))
    keys = ["uid", "part"]
    answers = requests.respond(asked.select(*keys, "request"), keys, users, items, scoring.init_layers())
    return requests.read_responses(asked, answers, keys).select("uid", "mid", rounded(F.col("score")).alias("score"))


def _ncf_pairs_sql(seen: str) -> str:
    """(uid, mid, score) of all users and items outside ``seen`` (uid, mid), the layers written out."""
    layers = scoring.init_layers()
    row = lambda v: "[" + ", ".join(repr(float(x)) for x in v) + "]"
    fixed = lambda v: f"cast({row(v)} as double[{len(v)}])"
    vector = lambda key, salt: "cast([" + ", ".join(f"0.1 * sin(0.7 * {key} + {1.3 * j + salt!r}::double)" for j in range(8)) + "] as double[8])"
    w0, d = layers.weights[0], scoring.LATENT_MLP
    part = lambda w, b, e: "[" + ", ".join(f"array_inner_product({e}, {fixed(r)}) + {float(x)!r}" for r, x in zip(w, b)) + "]"
    relu = lambda w, b, h: f"cast([{', '.join(f'greatest(array_inner_product({h}, {fixed(r)}) + {float(x)!r}, 0)' for r, x in zip(w, b))}] as double[{len(w)}])"
    h1 = "cast([" + ", ".join(f"greatest(a[{j + 1}] + b[{j + 1}], 0)" for j in range(len(w0))) + f"] as double[{len(w0)}])"
    mlp = len(layers.weights[-1])
    return f"""(with uidx as (select uid, row_number() over (order by uid) - 1 user_idx from (select distinct uid from ratings) t),
iidx as (select mid, row_number() over (order by mid) - 1 item_idx from (select distinct mid from items) t),
u as (select uid, {part(w0[:, :d], layers.biases[0], 'e')} a, {vector('user_idx', 2)} g from (select *, {vector('user_idx', 1)} e from uidx)),
i as (select mid, {part(w0[:, d:], [0.0] * len(w0), 'e')} b, {vector('item_idx', 4)} g from (select *, {vector('item_idx', 3)} e from iidx)),
h1 as (select u.uid, i.mid, {h1} h, cast([{', '.join(f'u.g[{j}] * i.g[{j}]' for j in range(1, 9))}] as double[8]) g from u cross join i
       where not exists (select 1 from {seen} r where r.uid = u.uid and r.mid = i.mid)),
h2 as (select uid, mid, g, {relu(layers.weights[1], layers.biases[1], 'h')} h from h1),
h3 as (select uid, mid, g, {relu(layers.weights[2], layers.biases[2], 'h')} h from h2)
select uid, mid, round(1 / (1 + exp(-(array_inner_product(h, {fixed(layers.out_w[:mlp])}) + array_inner_product(g, {fixed(layers.out_w[mlp:])})))), 6) score from h3)"""


@query("ncf_topn", "Q13 J16 U1 T12 F16 (all unseen items of every user NCF-scored, best 10 per user)", with_views(f"""
select uid, mid, score, cast(row_number() over (partition by uid order by score desc, mid) as bigint) rank
from {_ncf_pairs_sql('ratings')} s qualify rank <= {NCF_TOP_N}""", "ratings", "items"))
def ncf_topn(spark, d):
    """Every user against every item the user has not rated; no candidate stage."""
    _, users, items, _, _ = _ncf_inputs(spark, d)
    top = scoring.ncf_lists(users, items, src.ratings(spark, d), scoring.init_layers(), NCF_TOP_N)
    return top.select("uid", "rank", "mid", rounded(F.col("score")).alias("score"))


def _click_rows(spark, d):
    """(training rows, test rows, factors): labelled pairs with their features."""
    r = src.ratings(spark, d).withColumn("label", like_label(F.col("score"), STRICT_LIKE_THRESHOLD, True))
    train, test = als.holdout_split(r)
    m = als.written_once(lambda: train, spark, f"{d}#train", rank=8)
    return (*(scoring.click_features(x.select("uid", "mid", "label"), m.users, m.items) for x in (train, test)), m)


@query("click_model_auc", "F17 F18 A24 (MLP and FM click models on ALS factors, ROC AUC)")
def click_model_auc(spark, d):
    train, test, _ = _click_rows(spark, d)
    return scoring.click_model(train, test)


@query("click_model_topn", "F16 F17 Q13 T12 (the fitted click model scores all unseen items, best 10 per user)")
def click_model_topn(spark, d):
    train, _, m = _click_rows(spark, d)
    model = scoring.fit_click_model(train, "mlp")
    return scoring.click_lists(model, m.users, m.items, src.ratings(spark, d), NCF_TOP_N)


def _ncf_model(spark, d):
    """The NCF trained on the hash 80 % of the labelled ratings, over all users and items; fitted once per application."""
    def fit(settings):
        r = src.ratings(spark, d).withColumn("label", like_label(F.col("score"), STRICT_LIKE_THRESHOLD, True))
        train, _ = als.holdout_split(r)
        return ncf_training.fit_ncf(train, r.select("uid"), src.items(spark, d).select("mid"), settings)
    return ncf_training.fitted_once(fit, spark, d)


@query("ncf_trained_auc", "F17 F18 A24 (NCF trained by strata, 2 epochs of SGD on BCE; ROC AUC on the hash holdout)")
def ncf_trained_auc(spark, d):
    r = src.ratings(spark, d).withColumn("label", like_label(F.col("score"), STRICT_LIKE_THRESHOLD, True))
    _, test = als.holdout_split(r)
    area, n = ncf_training.auc(_ncf_model(spark, d), test)
    return spark.createDataFrame([("ncf", float(area), int(n))], "model string, auc double, n_test bigint")


@query("ncf_trained_topn", "F17 F16 Q13 J16 T12 (the trained NCF scores all unseen items, best 10 per user)")
def ncf_trained_topn(spark, d):
    m = _ncf_model(spark, d)
    top = scoring.ncf_lists(m.users, m.items, src.ratings(spark, d), m.layers, NCF_TOP_N)
    return top.select("uid", "rank", "mid", rounded(F.col("score")).alias("score"))
