"""Each operator of the engine as a query over the driver's tables, and as SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import accuracy, byte_label, clock_label, display_result, epoch_ms, expected_score, fallback_color, family, iso_date, last_mover, move_features, ply_count, residual, round_binary, speed_bucket, status
from .functions.board import with_board_features
from .operators import compare, features, rankings, sampling
from .plans import density, models, neighbours
from .schema import GAMES, V2_21
from .shared import shared_dir, stage
from .sources import feed, frames, openings_dim, pgn
from .sources.openings import read_openings, stored_openings, write_openings
from .view import LINES, LINES_SQL, SQL, TRANSCRIPTS_SQL, cut_lines, games, lines, openings, played, table, transcripts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

MIN_GAMES, SHRINK = 50, 2000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(x: Column | str) -> Column:
    """Rounded once from full precision, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _stored_games(spark: SparkSession, d: str) -> DataFrame:
    """`games` for those who read them more than once: joined once, and stored as one row for both players."""
    return games(spark, d, stage(lines(spark, d), "lines"))


def _players(spark: SparkSession, d: str, view: DataFrame | None = None) -> DataFrame:
    return features.player_features(games(spark, d) if view is None else view, MIN_GAMES)


_FEATURES_SQL = f"""
agg as (select username, count(*) n_games, avg(user_rating) avg_rating, count(*) filter (where has_eval) n_analyzed_games,
 sum(acpl*n_eval_moves) filter (where has_eval)/nullif(sum(n_eval_moves) filter (where has_eval),0) acpl, sum(blunders) filter (where has_eval)/nullif(sum(n_eval_moves) filter (where has_eval),0) blunder_rate,
 avg(sd) score_residual, avg(sd) filter (where color='white') white_score_residual, avg(sd) filter (where color='black') black_score_residual, avg(sd) filter (where n_moves>=80) long_game_residual,
 avg(case when result='draw' then 1e0 else 0e0 end) draw_rate, avg(case when status='mate' then 1e0 else 0e0 end) mate_rate, avg(case when status='outoftime' then 1e0 else 0e0 end) timeout_rate, avg(case when status='resign' then 1e0 else 0e0 end) resign_rate,
 avg(n_moves)/2 avg_moves, avg(case when n_moves<40 then 1e0 else 0e0 end) short_game_rate, count(distinct opening_eco)/count(*)::double opening_diversity,
 count(*) filter (where color='white' and el in ('B','C'))/nullif(count(*) filter (where color='white'),0)::double pct_e4_as_white,
 count(*) filter (where color='white' and el in ('D','E'))/nullif(count(*) filter (where color='white'),0)::double pct_d4_as_white,
 count(*) filter (where color='black' and el='B' and en>=20)/nullif(count(*) filter (where color='black' and el in ('B','C')),0)::double pct_sicilian_as_black,
 count(*) filter (where color='black' and el='C' and en<=19)/nullif(count(*) filter (where color='black' and el in ('B','C')),0)::double pct_french_as_black,
 count(*) filter (where color='black' and el='B' and en between 10 and 19)/nullif(count(*) filter (where color='black' and el in ('B','C')),0)::double pct_carokann_as_black,
 count(*) filter (where color='black' and el='C' and en>=20)/nullif(count(*) filter (where color='black' and el in ('B','C')),0)::double pct_e5_as_black,
 avg(castle_ply) avg_castle_move, avg(case when castle_qside then 1e0 else 0e0 end) filter (where castle_ply is not null) pct_queenside_castle, avg(queens_off_ply) avg_queens_off_move, avg(early_pawn) early_pawn_pushes
 from ann group by username having count(*)>={MIN_GAMES})
"""
_META = ["n_games", "avg_rating", "n_analyzed_games", "acpl", "blunder_rate"]
_ALL = [*_META[1:2], *_META[3:], *V2_21]
_FILLED = {c: f"coalesce({c}, score_residual)" for c in features.FROM_OWN} | {c: f"coalesce({c}, avg({c}) over ())" for c in features.FROM_ALL}


def _select(expr: dict[str, str]) -> str:
    return "username, n_games, n_analyzed_games, " + ", ".join(f"round({expr.get(c, c)},9)+0e0 {c}" for c in _ALL)  # shares of a few hundred games end within nine places, so none is a tie


@query(f"with {SQL} select color, result, count(*) n from games group by 1,2")
def q_two_perspectives(spark: SparkSession, d: str) -> DataFrame:
    return games(spark, d).groupBy("color", "result").agg(F.count("*").alias("n"))


@query(f"with {SQL} select color, result, round(avg(sd),6)+0e0 sd, round(avg(1e0/(1e0+power(10e0,(opponent_rating-user_rating)/400e0))),6)+0e0 expected from ann group by 1,2")
def q_elo_residual(spark: SparkSession, d: str) -> DataFrame:
    return games(spark, d).groupBy("color", "result").agg(r6(F.avg(residual())).alias("sd"), r6(F.avg(expected_score())).alias("expected"))


@query(f"with {SQL}, {_FEATURES_SQL} select {_select({})} from agg")
def q_player_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_players(spark, d), 9)


@query(f"with {SQL}, {_FEATURES_SQL} select {_select(_FILLED)} from agg")
def q_player_features_imputed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.impute(_players(spark, d)), 9)


@query(f"""with {SQL}, g as (select color, family, count(*) n, count(*)/(count(*)+{SHRINK}e0)*avg(sd) s from ann group by 1,2 having count(*)>={MIN_GAMES})
select * from (select color, row_number() over (partition by color order by s desc, family) rank, family "name", n, round(s,6)+0e0 score_residual from g) where rank<=5""")
def q_top_families(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the families that each colour does best in."""
    everyone = games(spark, d).withColumn("family", family()).withColumn("sd", residual())
    pooled = everyone.groupBy("color", "family").agg(F.count("*").alias("n"), F.avg("sd").alias("raw"))
    return rounded(rankings._ranked(pooled, [], MIN_GAMES, 5, SHRINK))


@query(f"with {SQL} select owner, count(*) n, count(distinct family) families from ann group by 1")
def q_owner_color(spark: SparkSession, d: str) -> DataFrame:
    return rankings.with_owner(games(spark, d), openings(spark, d)).groupBy("owner").agg(F.count("*").alias("n"), F.countDistinct("family").alias("families"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    white = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("username"), F.col("c_mktsegment").alias("cohort"))
    return white.unionByName(table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("username"), F.concat(F.lit("N"), "s_nationkey").alias("cohort")))


@query(f"""with {SQL}, g as (select segment cohort, color, family, count(*) n, count(*)/(count(*)+{SHRINK}e0)*avg(sd) s from ann where color=owner group by 1,2,3 having count(*)>={MIN_GAMES})
select * from (select cohort, color, row_number() over (partition by cohort, color order by s desc, family) rank, family "name", n, round(s,6)+0e0 score_residual from g) where rank<=5""")
def q_cohort_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rankings.rank_openings(games(spark, d), _members(spark, d), dim=openings(spark, d), min_games=MIN_GAMES, shrinkage_k=SHRINK))


@query(f"with {SQL} select segment cohort, color, family, count(*) n, round(count(*)/(count(*)+{SHRINK}e0)*avg(sd),6)+0e0 resid from ann group by 1,2,3 having count(*)>={MIN_GAMES}")
def q_residual_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rankings.residual_table(games(spark, d), _members(spark, d), min_games=MIN_GAMES, shrinkage_k=SHRINK))


@query(f"with {SQL} select username, color, family, count(*) n, round(sum(sd),6)+0e0 sum_sd from ann where color=owner group by 1,2,3")
def q_family_blocks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rankings.family_blocks(games(spark, d), dim=openings(spark, d)))


@query(f"""with {SQL}, b as (select segment cohort, username, color, family, count(*) n, sum(sd) x from ann where color=owner group by 1,2,3,4),
g as (select cohort, color, family, cast(sum(n) as bigint) n, sum(n)/(sum(n)+{SHRINK}e0)*(sum(x)/sum(n)) s from b group by 1,2,3 having sum(n)>={MIN_GAMES})
select * from (select cohort, color, row_number() over (partition by cohort, color order by s desc, family) rank, family "name", n, round(s,6)+0e0 score_residual from g) where rank<=5""")
def q_pool_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = rankings.family_blocks(games(spark, d), dim=openings(spark, d))
    return rounded(rankings.pool_blocks(blocks, _members(spark, d), min_games=MIN_GAMES, shrinkage_k=SHRINK))


@query(f"""with {SQL}, a as (select segment, color, family, count(*) n, count(*)/(count(*)+{SHRINK}e0)*avg(sd) s from ann where color=owner group by 1,2,3 having count(*)>={MIN_GAMES}),
u as (select segment, username, color, family, count(*) n, sum(sd) x from ann where color=owner group by 1,2,3,4), b as (select segment, color, family, sum(n) n, sum(n)/(sum(n)+{SHRINK}e0)*(sum(x)/sum(n)) s from u group by 1,2,3 having sum(n)>={MIN_GAMES})
select count(*) "groups", count(*) filter (where not coalesce(a.n=b.n and abs(a.s-b.s)<1e-9, false)) mismatches from a full join b using (segment, color, family)""")
def q_served_equals_games(spark: SparkSession, d: str) -> DataFrame:
    """The ranking from games and the one from stored blocks, side by side."""
    g, dim, members = _stored_games(spark, d), openings(spark, d), _members(spark, d)
    keys = ["cohort", "color", "name"]
    a = rankings.rank_openings(g, members, dim=dim, min_games=MIN_GAMES, top_n=None, shrinkage_k=SHRINK).select(*keys, F.col("n").alias("n1"), F.col("score_residual").alias("s1"))
    b = rankings.pool_blocks(rankings.family_blocks(g, dim=dim), members, min_games=MIN_GAMES, top_n=None, shrinkage_k=SHRINK).select(*keys, F.col("n").alias("n2"), F.col("score_residual").alias("s2"))
    same = F.coalesce((F.col("n1") == F.col("n2")) & (F.abs(F.col("s1") - F.col("s2")) < 1e-9), F.lit(False))
    return a.join(b, keys, "full").agg(F.count("*").alias("groups"), F.count_if(~same).alias("mismatches"))


@query(f"""with {SQL}, t as (select segment cohort, color, family, count(*)/(count(*)+{SHRINK}e0)*avg(sd) resid from ann group by 1,2,3 having count(*)>={MIN_GAMES}),
r as (select *, resid-avg(resid) over (partition by cohort, color) rel from t),
m as (select w.cohort white_cohort, b.cohort black_cohort, w.family, w.rel white_rel, b.rel black_rel, w.rel+b.rel combined from r w join r b on w.family=b.family and w.color='white' and b.color='black')
select * from (select white_cohort, black_cohort, row_number() over (partition by white_cohort, black_cohort order by combined desc, family) rank, family, round(white_rel,6)+0e0 white_rel, round(black_rel,6)+0e0 black_rel, round(combined,6)+0e0 combined, white_rel>0 and black_rel>0 both_positive from m) where rank<=6""")
def q_mutual_openings(spark: SparkSession, d: str) -> DataFrame:
    t = rankings.residual_table(games(spark, d), _members(spark, d), min_games=MIN_GAMES, shrinkage_k=SHRINK)
    return rounded(rankings.mutual_openings(t))


def _two(sql: str) -> str:
    return f"with {SQL}, {_FEATURES_SQL}, p as (select {', '.join(f'cast({_FILLED.get(c, c)} as double) {c}' for c in V2_21)}, username from agg), u as (unpivot p on {', '.join(V2_21)} into name feature value v) {sql}"


@query(_two("select x.feature, round(x.v,6)+0e0 a, round(y.v,6)+0e0 b, round(x.v-y.v,6)+0e0 delta from u x join u y on x.feature=y.feature where x.username=(select min(username) from p) and y.username=(select max(username) from p)"))
def q_feature_delta(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last player, by name."""
    filled = stage(features.impute(_players(spark, d)), "players")
    ends = filled.agg(F.min("username").alias("lo"), F.max("username").alias("hi"))
    a, b = (filled.join(F.broadcast(ends), F.col("username") == F.col(x)) for x in ("lo", "hi"))
    return rounded(compare.feature_delta(a, b, V2_21))


def _clustered(spark: SparkSession, d: str, view: DataFrame | None = None) -> DataFrame:
    """Players with a cluster by their number."""
    filled = features.impute(_players(spark, d, view))
    return filled.withColumn("cluster", (F.regexp_extract("username", r"(\d+)", 1).cast("bigint") % 5).cast("int"))


_CLUSTER = "cast(cast(substr(username,2) as bigint)%5 as int)"


@query(f"with {SQL}, {_FEATURES_SQL}, p as (select {_select(_FILLED)} from agg) select {_CLUSTER} \"cluster\", count(*) size, {', '.join(f'round(avg({_FILLED.get(c, c)}),6)+0e0 {c}' for c in ('avg_rating', 'draw_rate', 'avg_moves', 'opening_diversity'))} from agg group by 1")
def q_cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.cluster_summary(_clustered(spark, d), ["avg_rating", "draw_rate", "avg_moves", "opening_diversity"]))


@query(f"""with {SQL}, s as (select el "cluster", avg(sd) sd, avg(n_moves) n_moves from ann where color='white' group by 1)
select "cluster", round((sd-avg(sd) over ())/stddev_samp(sd) over (),6)+0e0 sd, round((n_moves-avg(n_moves) over ())/stddev_samp(n_moves) over (),6)+0e0 n_moves from s""")
def q_zscore(spark: SparkSession, d: str) -> DataFrame:
    white = games(spark, d).where("color='white'").withColumn("cluster", F.substring("opening_eco", 1, 1)).withColumn("sd", residual())
    return rounded(compare.z_scores(compare.cluster_summary(white, ["sd", "n_moves"]), ["sd", "n_moves"]))


@query("select user_id%7 a, event_type b, count(*) n, round(count(*)/sum(count(*)) over (partition by user_id%7),6)+0e0 share from events group by 1,2")
def q_crosstab(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("username"), (F.col("user_id") % 7).alias("a"), F.col("event_type").alias("b"))
    return rounded(compare.row_shares(compare.crosstab(e.select("username", "a"), e.select("username", "b"))))


@query("with c as (select user_id%7 a, event_type b, count(*) n from events group by 1,2), s as (select a, max(n)/sum(n) share from c group by 1) select round(avg(share),6)+0e0 mean_purity from s")
def q_purity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("username"), (F.col("user_id") % 7).alias("a"), F.col("event_type").alias("b"))
    return rounded(compare.purity(compare.crosstab(e.select("username", "a"), e.select("username", "b")))[1])


@query(f"with {SQL}, {_FEATURES_SQL} select {_CLUSTER} \"cluster\", round(avg(acpl),6)+0e0 avg_acpl, round(avg(blunder_rate),6)+0e0 avg_blunder_rate, count(*) n_players from agg where n_analyzed_games>=3 group by 1")
def q_accuracy_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.accuracy_by_cluster(_clustered(spark, d)))


@query(f"with {SQL}, {_FEATURES_SQL} select {_CLUSTER} \"cluster\", round(avg(acpl),6)+0e0 avg_acpl, round(avg(blunder_rate),6)+0e0 avg_blunder_rate, count(*) n_players from agg where n_analyzed_games>=3 and avg_rating between 300 and 700 group by 1")
def q_banded(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.accuracy_by_cluster(_clustered(spark, d), band=(300, 700)))



def _as_games(spark: SparkSession, d: str) -> DataFrame:
    """Orders as parsed games: priorities are results, keys are ratings and clocks."""
    o = table(spark, d, "orders")
    tags = {
        "Variant": F.when(F.col("o_orderstatus") == "P", "Chess960").otherwise("Standard"), "Rated": F.lit("True"),
        "White": F.when(F.col("o_custkey") % 11 == 0, "?").otherwise(F.col("o_custkey").cast("string")), "Black": F.lit("b"),
        "WhiteElo": F.when(F.col("o_orderkey") % 13 == 0, "x").otherwise((F.col("o_orderkey") % 3600).cast("string")), "BlackElo": F.lit("1500"),
        "Result": F.when(F.startswith("o_orderpriority", F.lit("5")), "*").otherwise("1-0"), "ECO": F.lit("B20"), "Opening": F.lit("Sicilian Defense"),
        "TimeControl": F.concat((F.col("o_orderkey") % 2000).cast("string"), F.lit("+3")), "Termination": F.lit("Normal"), "Site": F.lit(None).cast("string"), "UTCDate": F.lit(None).cast("string"), "UTCTime": F.lit(None).cast("string"),
    }
    return o.select(*(c.alias(n) for n, c in tags.items()), F.split(F.lit("e4 c5 Nf3 d6 d4"), " ").alias("moves"), F.array().cast("array<int>").alias("evals"))


@query("""with j as (select o_orderkey%2000+120 est, case when o_orderstatus='P' or o_custkey%11=0 or o_orderkey%13=0 or o_orderpriority like '5%' then 'filtered' end f, o_orderkey%3600 elo from orders)
select case when f is not null then f when est<180 then 'filtered_speed' when elo not between 800 and 3500 then 'filtered_rating' else 'kept' end reason, count(*) n from j group by 1""")
def q_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return pgn.reject_counts(pgn.judged(_as_games(spark, d)))


@query("select l_returnflag, round(sum(l_discount*l_quantity) filter (where l_tax>=0.04e0)/nullif(sum(l_quantity) filter (where l_tax>=0.04e0),0),6)+0e0 weighted from lineitem group by 1")
def q_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    on = F.col("l_tax") >= 0.04
    mean = F.try_divide(F.sum(F.when(on, F.col("l_discount") * F.col("l_quantity"))), F.sum(F.when(on, F.col("l_quantity"))))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(mean).alias("weighted"))


@query("select l_suppkey, round((count(distinct nullif(l_linenumber,1))+max(case when l_linenumber=1 then 1 else 0 end))/count(*)::double,6)+0e0 diversity from lineitem group by 1")
def q_diversity(spark: SparkSession, d: str) -> DataFrame:
    x = F.nullif("l_linenumber", F.lit(1))
    found = (F.size(F.collect_set(x)) + F.max(x.isNull().cast("int"))) / F.count("*")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(r6(found).alias("diversity"))


@query("""with t as (select l_linenumber*50 + 40*(l_orderkey%30) est from lineitem)
select case when est<30 then 'ultraBullet' when est<180 then 'bullet' when est<480 then 'blitz' when est<1500 then 'rapid' else 'classical' end speed, count(*) n from t group by 1""")
def q_speed_bucket(spark: SparkSession, d: str) -> DataFrame:
    clock = F.concat((F.col("l_linenumber") * 50).cast("string"), F.lit("+"), (F.col("l_orderkey") % 30).cast("string"))
    return table(spark, d, "lineitem").groupBy(speed_bucket(clock).alias("speed")).agg(F.count("*").alias("n"))


@query("""select case when o_orderpriority like '1%' then 'outoftime' when o_orderpriority like '2%' then 'noStart' when o_orderstatus='P' then 'draw' when o_orderkey%2=0 then 'mate' else 'resign' end status, count(*) n from orders group by 1""")
def q_status(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.startswith("o_orderpriority", F.lit("1")), "Time forfeit").when(F.startswith("o_orderpriority", F.lit("2")), "Abandoned").otherwise("Normal")
    result = F.when(F.col("o_orderstatus") == "P", "1/2-1/2").otherwise("1-0")
    moves = F.when(F.col("o_orderkey") % 2 == 0, "e4 e5 Qh7#").otherwise("e4 e5 Kf8")
    return table(spark, d, "orders").groupBy(status(end, result, moves).alias("status")).agg(F.count("*").alias("n"))


@query("""select concat('g', o_orderkey) game_id, case when o_orderkey%2=0 then concat('c', o_custkey) else concat('D', o_custkey%97) end username, case when o_orderkey%2=0 then 'white' else 'black' end color,
case when o_orderstatus='P' then 'draw' when (o_orderstatus='F') = (o_orderkey%2=0) then 'win' else 'loss' end result, cast(o_orderkey%3 as int) n_moves, cast(case when o_orderkey%2=0 then o_custkey%900 else o_orderkey%900 end as int) user_rating, cast(case when o_orderkey%2=0 then o_orderkey%900 else o_custkey%900 end as int) opponent_rating from orders where o_orderkey%7<>0""")
def q_json_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a feed's lines of JSON; each asked for by one of its players, by none of them if divisible by 7."""
    o = table(spark, d, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    white, black = F.concat(F.lit("C"), cust), F.concat(F.lit("D"), cust % 97)
    player = lambda name, rating: F.struct(F.struct(name.alias("name")).alias("user"), rating.cast("int").alias("rating"))
    winner = F.when(F.col("o_orderstatus") == "F", "white").when(F.col("o_orderstatus") == "O", "black")
    line = F.to_json(F.struct(F.concat(F.lit("g"), key).alias("id"), winner.alias("winner"), F.array_join(F.array_repeat(F.lit("e4"), (key % 3).cast("int")), " ").alias("moves"), F.struct(player(white, cust % 900).alias("white"), player(black, key % 900).alias("black")).alias("players")))
    target = F.when(key % 7 == 0, F.lit("nobody")).when(key % 2 == 0, F.lower(white)).otherwise(black)
    games_, _ = feed.fetched_games(o.select(target.alias("target"), line.alias("line"), F.lit(None).cast("string").alias("error")))
    return games_.select("game_id", "username", "color", "result", "n_moves", "user_rating", "opponent_rating")


@query("select case when regexp_matches(lower(text), 'defense|defence|indian|marshall attack|schliemann|albin counter|benoni|benko|grünfeld|grunfeld') then 'black' else 'white' end color, count(*) n from documents group by 1")
def q_regex_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(fallback_color("text").alias("color")).agg(F.count("*").alias("n"))


@query("select event_type, max(epoch_us(ts)//1000000*1000) last_ms, cast(sum(epoch_us(ts)//1000000%1000) as bigint) s, strftime(max(ts), '%Y-%m-%d') last_day from events group by 1")
def q_epoch_ms(spark: SparkSession, d: str) -> DataFrame:
    """Days and times as a transcript tells them, to milliseconds and back to the day."""
    e = table(spark, d, "events").select("event_type", epoch_ms(F.date_format("ts", "yyyy.MM.dd"), F.date_format("ts", "HH:mm:ss")).alias("ms"))
    return e.groupBy("event_type").agg(F.max("ms").alias("last_ms"), F.sum((F.col("ms") / 1000).cast("bigint") % 1000).alias("s"), F.max(iso_date("ms")).alias("last_day"))


@query("select lower(c_mktsegment) \"name\", max(c_acctbal) best from customer group by 1")
def q_max_by_lower(spark: SparkSession, d: str) -> DataFrame:
    return sampling.best_by_lower(table(spark, d, "customer"), "c_mktsegment", "c_acctbal")


@query("""select lower(concat('C', o_custkey)) "name", cast(max(o_orderkey%3000) as int) rating from orders where o_orderkey%3000<2200 and o_orderkey%3000<>0 and o_custkey not in (select o_custkey from orders where o_orderstatus='P') group by 1""")
def q_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """All opponents under the cap who aren't known yet, each with the best rating that counts."""
    o = table(spark, d, "orders")
    name = F.concat(F.lit("C"), "o_custkey")
    found = o.select(name.alias("opponent_username"), (F.col("o_orderkey") % 3000).cast("int").alias("opponent_rating"))
    return feed.diverse_players(found, o.where("o_orderstatus = 'P'").select(F.lower(name).alias("name")), 2**31 - 1)


@query("""with a as (select distinct o_custkey k from orders where o_orderstatus='F'), b as (select distinct o_custkey k from orders where o_orderstatus='O')
select 'union' op, count(*) n from (select k from a union select k from b) union all select 'intersect', count(*) from (select k from a intersect select k from b) union all select 'subtract', count(*) from (select k from a except select k from b) union all select 'concat', (select count(*) from a)+(select count(*) from b)""")
def q_set_ops(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct() for s in "FO")
    made = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "subtract": a.subtract(b), "concat": a.unionByName(b)}
    out = None
    for name, df in made.items():
        one = df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("with h as (select event_id, ((((event_id%2147483647)*48271+42)%2147483647)*48271+7)%2147483647 h from events) select event_id from h order by h, event_id limit 100")
def q_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.exact_sample(table(spark, d, "events"), "event_id", 100).select("event_id")


@query("with h as (select event_id, ((((event_id%2147483647)*48271+42)%2147483647)*48271+7)%2147483647%4 part from events) select part, count(*) n from h group by 1")
def q_split_sample(spark: SparkSession, d: str) -> DataFrame:
    e, out = table(spark, d, "events"), None
    for part in range(4):
        one = sampling.split_sample(e, "event_id", 4, part).agg(F.lit(part).cast("bigint").alias("part"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""with r as (select p_name "name", p_size%9+1 plies, row_number() over (partition by p_name order by p_size%9+1, p_brand) rn from part where p_partkey%10<>0) select "name", case when plies%2=1 then 'white' else 'black' end color from r where rn=1""")
def q_shortest_per_name(spark: SparkSession, d: str) -> DataFrame:
    """Parts as opening lines; some hold a token that is no move."""
    moves = F.array_join(F.array_repeat(F.lit("Nf3"), (F.col("p_size") % 9 + 1).cast("int")), " ")
    line = F.concat(F.lit("1. "), moves, F.when(F.col("p_partkey") % 10 == 0, " zz").otherwise(""))
    return openings_dim(table(spark, d, "part").select(F.col("p_brand").alias("eco"), F.col("p_name").alias("name"), line.alias("pgn")), replay=False)


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")


def _first_vector(rows: DataFrame, i: int = 0) -> list[float]:
    return list(rows.where(F.col("id") == i).first()["features"])


_V = "v as (select vec_id id, cast(embedding as double[]) f, label from embeddings)"


@query(f"with {_V} select a.id, round(list_distance(a.f, q.f),6)+0e0 dist from v a, v q where q.id=0 and a.id<>0 order by list_distance(a.f, q.f), a.id limit 5")
def q_knn(spark: SparkSession, d: str) -> DataFrame:
    rows = _embedded(spark, d)
    q = F.array(*map(F.lit, _first_vector(rows)))
    return rounded(neighbours.nearest(rows, q, 5, exclude=0).select("id", "dist"))


@query(f"with {_V} select * from (select q.id query, a.id, round(list_distance(a.f, q.f),6)+0e0 dist, cast(row_number() over (partition by q.id order by list_distance(a.f, q.f), a.id) as int) rank from v a join v q on a.id<>q.id and q.id%20=0) where rank<=5")
def q_knn_many(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20, against all."""
    rows = _embedded(spark, d)
    return rounded(neighbours.nearest_many(rows, rows.where("id % 20 = 0"), 5).select("query", "id", "dist", "rank"))


@query(f"with {_V}, n as (select a.label from v a, v q where q.id=0 and a.id<>0 order by list_distance(a.f, q.f), a.id limit 50) select label, count(*) n from n group by 1")
def q_knn_pool(spark: SparkSession, d: str) -> DataFrame:
    rows = _embedded(spark, d)
    near = neighbours.nearest(rows, F.array(*map(F.lit, _first_vector(rows))), 50, exclude=0)
    return near.groupBy("label").agg(F.count("*").alias("n"))


@query("select o_orderkey, round((o_totalprice-avg(o_totalprice) over ())/stddev_pop(o_totalprice) over (),6)+0e0 z from orders")
def q_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = models.vectors(table(spark, d, "orders"), "o_orderkey", ["o_totalprice"])
    return models.scale(rows, models.fit_scaler(rows)).select(F.col("id").alias("o_orderkey"), r6(F.col("features")[0]).alias("z"))


_ASSIGN = f"{_V}, a as (select id, k, dist from (select v.id, c.id k, list_distance(v.f, c.f) dist, row_number() over (partition by v.id order by list_distance(v.f, c.f), c.id) rn from v, v c where c.id<5) where rn=1)"


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    rows = _embedded(spark, d)
    seeds = {r["id"]: list(r["features"]) for r in rows.where("id < 5").collect()}
    return models.assign(rows.select("id", "features"), [seeds[i] for i in sorted(seeds)])


@query(f"with {_ASSIGN} select id, cast(k as int) \"cluster\", round(dist,6)+0e0 dist from a")
def q_assign(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_assigned(spark, d).select("id", "cluster", "dist"))


@query(f"with {_ASSIGN}, e as (select a.k, unnest(range(0,64)) i, v.f from a join v on a.id=v.id) select cast(k as int) \"cluster\", cast(i as int) i, count(*) size, round(avg(f[i+1]),6)+0e0 m from e group by 1,2")
def q_lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.lloyd_step(_assigned(spark, d)).select("cluster", F.posexplode("centre").alias("i", "m"), "size"))


def _rounds_sql(rounds: int = 3) -> str:
    steps = [_V, "c0 as (select id k, f from v where id < 5)"]
    for r in range(rounds):
        steps.append(f"a{r} as materialized (select id, arg_min(k, d) k from (select v.id, c.k, list_distance(v.f, c.f) d from v, c{r} c) group by 1)")
        steps.append(f"c{r + 1} as materialized (select k, list(m order by i) f from (select k, i, avg(f[i+1]) m from (select a.k, v.f, unnest(range(64)) i from a{r} a join v using (id)) group by 1, 2) group by 1)")
    return f"with {', '.join(steps)} select cast(k as int) \"cluster\", cast(i as int) i, round(f[i+1],6)+0e0 m from (select k, f, unnest(range(64)) i from c{rounds})"


@query(_rounds_sql())
def q_kmeans_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of K-Means from the first five vectors."""
    rows = stage(_embedded(spark, d).select("id", "features"), "vectors")
    seeds = {r["id"]: list(r["features"]) for r in rows.where("id < 5").collect()}
    found = models.refine(rows, [seeds[i] for i in sorted(seeds)], 3)
    one = spark.createDataFrame(list(enumerate(found)), "cluster int, centre array<double>")
    return rounded(one.select("cluster", F.posexplode("centre").alias("i", "m")))


@query(f"with {_ASSIGN} select round(sum(dist*dist),6)+0e0 inertia from a")
def q_inertia(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.inertia(_assigned(spark, d)))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" union all ".join(f"select '{a}' a, '{b}' b, round(corr({a},{b}),6)+0e0 r from lineitem" for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :]))
def q_corr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.correlation(table(spark, d, "lineitem"), _MEASURES))


@query(" union all ".join(f"select '{c}' feature, count({c}) n, count(*)-count({c}) nulls, round(avg({c}),6)+0e0 mean, round(stddev_samp({c}),6)+0e0 std, round(min({c}),6)+0e0 min, round(quantile_cont({c},0.25),6)+0e0 q25, round(quantile_cont({c},0.5),6)+0e0 q50, round(quantile_cont({c},0.75),6)+0e0 q75, round(max({c}),6)+0e0 max from lineitem" for c in _MEASURES))
def q_describe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.describe(table(spark, d, "lineitem"), _MEASURES))


@query("""with e as (select min(o_totalprice) lo, max(o_totalprice) hi from orders), b as (select least(30, cast(floor((o_totalprice-lo)/((hi-lo)/30)) as int)+1) bin, lo, hi from orders, e)
select bin, round(lo+(bin-1)*((hi-lo)/30),6)+0e0 low, round(lo+bin*((hi-lo)/30),6)+0e0 high, count(*) n from b group by bin, lo, hi""")
def q_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.histogram(table(spark, d, "orders"), "o_totalprice", 30))


@query(f"with {SQL} select status, count(*) n from games group by 1")
def q_counts(spark: SparkSession, d: str) -> DataFrame:
    return compare.counts(games(spark, d), "status")


@query(f"with {SQL}, c as (select username, count(*) c from games group by 1) select unnest([10,20,50,100,500]) threshold, unnest([count(*) filter (where c>=10), count(*) filter (where c>=20), count(*) filter (where c>=50), count(*) filter (where c>=100), count(*) filter (where c>=500)]) n from c")
def q_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return compare.at_least(games(spark, d), "username", [10, 20, 50, 100, 500])


@query("with a as (select distinct o_custkey k from orders where o_orderstatus='F'), b as (select distinct o_custkey k from orders where o_orderstatus='O') select (select count(*) from a) a, (select count(*) from b) b, (select count(*) from a join b using (k)) \"both\"")
def q_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("username"), "o_orderstatus")
    return compare.overlap(o.where("o_orderstatus='F'"), o.where("o_orderstatus='O'"))


@query(f"""with {_V}, p as (select a.id, a.label, b.label bl, avg(list_distance(a.f,b.f)) m from v a join v b on a.id<>b.id group by 1,2,3),
s as (select id, max(case when bl=label then m end) a, min(case when bl<>label then m end) b from p group by 1) select round(avg(case when a is null then 0e0 else (b-a)/greatest(a,b) end),6)+0e0 silhouette from s""")
def q_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.silhouette(_embedded(spark, d).withColumn("cluster", F.col("label"))))


_STYLE = ["avg_rating", "avg_moves", "draw_rate"]
_NEAR = 60


def _near(spark: SparkSession, d: str, view: DataFrame | None = None) -> tuple[DataFrame, Column, str, DataFrame]:
    """Vectors of all players, the first player's own, the name, and the players."""
    filled = stage(features.impute(_players(spark, d, view)), "players")
    rows = models.vectors(filled, "username", _STYLE)
    first = filled.agg(F.min("username")).first()[0]
    return rows, F.array(*map(F.lit, rows.where(F.col("id") == first).first()["features"])), first, filled


_NEAR_SQL = f"""{SQL}, {_FEATURES_SQL}, p as (select username, avg_rating, [{", ".join(f"cast({_FILLED.get(c, c)} as double)" for c in _STYLE)}] f, n_games from agg), me as (select * from p where username=(select min(username) from p)),
nn as (select p.username, p.avg_rating from p, me where p.username<>me.username order by list_distance(p.f, me.f), p.username limit {_NEAR}),
near_g as (select color, family, count(*) n, count(*)/(count(*)+{SHRINK}e0)*avg(sd) s from ann join nn using (username) where color=owner group by 1,2 having count(*)>={MIN_GAMES}),
near_r as (select color, row_number() over (partition by color order by s desc, family) rank, family "name", n, round(s,6)+0e0 score_residual from near_g)"""


@query(f"with {_NEAR_SQL} select * from near_r where rank<=5")
def q_knn_recommend_games(spark: SparkSession, d: str) -> DataFrame:
    """Openings of the nearest players, from their games."""
    view = _stored_games(spark, d)
    rows, me, name, _ = _near(spark, d, view)
    return rounded(neighbours.recommend_from_games(rows, me, view, k=_NEAR, exclude=name, dim=openings(spark, d), min_games=MIN_GAMES, shrinkage_k=SHRINK))


@query(f"with {_NEAR_SQL} select * from near_r where rank<=5")
def q_knn_recommend_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same from stored blocks."""
    view = _stored_games(spark, d)
    rows, me, name, _ = _near(spark, d, view)
    blocks = rankings.family_blocks(view, dim=openings(spark, d))
    return rounded(neighbours.recommend_from_blocks(rows, me, blocks, k=_NEAR, exclude=name, min_games=MIN_GAMES, shrinkage_k=SHRINK))


@query(f"""with {_NEAR_SQL} select me.username, me.n_games n_games_used, round(me.avg_rating,9)+0e0 user_rating, (select count(*) from nn) size, (select round(avg(avg_rating),9)+0e0 from nn) avg_rating, color, rank, r."name", n, score_residual from me, near_r r where rank<=5""")
def q_knn_answer(spark: SparkSession, d: str) -> DataFrame:
    """The answer's JSON, read back: the player, the neighbourhood and its openings."""
    view = _stored_games(spark, d)
    rows, me, name, players = _near(spark, d, view)
    near = neighbours.nearest(rows, me, _NEAR, name).join(players.select(F.col("username").alias("id"), "avg_rating"), "id")
    ranked = neighbours.recommend_from_games(rows, me, view, k=_NEAR, exclude=name, dim=openings(spark, d), min_games=MIN_GAMES, shrinkage_k=SHRINK)
    told = compare.knn_answer(players.where(F.col("username") == name).select("username", "avg_rating", F.col("n_games").alias("n_games_used")), near, ranked)
    item = "array<struct<name: string, n: bigint, score_residual: double>>"
    a = told.select(F.from_json("json", f"username string, n_games_used bigint, user_rating double, cluster struct<size: bigint, avg_rating: double>, top_openings struct<white: {item}, black: {item}>").alias("a")).select("a.*")
    out = None
    for color in ("white", "black"):
        one = a.select("username", "n_games_used", "user_rating", "cluster.size", "cluster.avg_rating", F.lit(color).alias("color"), F.posexplode(f"top_openings.{color}").alias("at", "o"))
        one = one.select("username", "n_games_used", "user_rating", "size", "avg_rating", "color", (F.col("at") + 1).alias("rank"), "o.*")
        out = one if out is None else out.unionByName(one)
    return out.withColumns({c: F.round(c, 9 if c.endswith("rating") else 6) + F.lit(0.0) for c in ("user_rating", "avg_rating", "score_residual")})  # ratings of few games may be ties at six places


_DOCUMENT_SQL = f"""{SQL}, {_FEATURES_SQL}, c as (select {_CLUSTER} id, * from agg), ca as (select c.id, ann.* from ann join c using (username)),
d_g as (select id, color, family, count(*) n, count(*)/(count(*)+{SHRINK}e0)*avg(sd) s from ca where color=owner group by 1,2,3 having count(*)>={MIN_GAMES}),
d_r as (select id, color, row_number() over (partition by id, color order by s desc, family) rank, family "name", n, round(s,6)+0e0 score_residual from d_g),
d_t as (select id, color, family, count(*)/(count(*)+{SHRINK}e0)*avg(sd) resid from ca group by 1,2,3 having count(*)>={MIN_GAMES})"""


@query(f"""with {_DOCUMENT_SQL}, size as (select id, count(*) size, round(avg(avg_rating),9)+0e0 avg_rating from c group by 1), k as (select id, count(*) families from d_t group by 1)
select id, size, avg_rating, families, color, rank, "name", n, score_residual from d_r join size using (id) join k using (id) where rank<=5""")
def q_document_openings(spark: SparkSession, d: str) -> DataFrame:
    """The recommendation document written, reread and laid out: clusters and their openings."""
    at = f"{shared_dir(spark)}/document-{uuid.uuid4().hex}"
    rankings.write_document(q_recommendation_document(spark, d), at)
    clusters = rankings.read_document(spark, at).select(F.explode("clusters").alias("c")).select("c.*")
    families = F.size("family_residuals.white") + F.size("family_residuals.black")
    out = None
    for color in ("white", "black"):
        one = clusters.select("id", "size", "avg_rating", families.cast("bigint").alias("families"), F.lit(color).alias("color"), F.posexplode(f"top_openings.{color}").alias("at", "o"))
        one = one.select("id", "size", "avg_rating", "families", "color", (F.col("at") + 1).alias("rank"), "o.*")
        out = one if out is None else out.unionByName(one)
    return out.withColumns({"avg_rating": F.round("avg_rating", 9) + F.lit(0.0), "score_residual": r6("score_residual")})


@query(f"with {SQL}, {_FEATURES_SQL}, p as (select username, {_CLUSTER} c, n_games, {', '.join(f'cast({_FILLED.get(c, c)} as double) {c}' for c in V2_21)} from agg), u as (unpivot p on {', '.join(V2_21)} into name feature value v), m as (select c, feature, avg(v) m from u group by 1,2) select username, n_games n_games_used, feature, round(v,9)+0e0 \"user\", round(m,9)+0e0 cluster_mean, round(v-m,9)+0e0 delta from u join m using (c, feature)")
def q_answer_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Every player's answer, read back: how the player differs from the cluster."""
    told = q_recommend_answer(spark, d).select(F.from_json("json", "username string, n_games_used bigint, feature_comparison array<struct<feature: string, user: double, cluster_mean: double, delta: double>>").alias("a"))
    return rounded(told.select("a.username", "a.n_games_used", F.explode("a.feature_comparison").alias("f")).select("username", "n_games_used", "f.*"), 9)


@query(f"""with {_DOCUMENT_SQL}, r as (select *, resid-avg(resid) over (partition by id, color) rel from d_t), e as (select min(username) lo, max(username) hi from c), pair as (select a.id x, b.id y from e join c a on a.username=lo join c b on b.username=hi),
w as (select 'a_white_b_black' way, x wc, y bc from pair union all select 'b_white_a_black', y, x from pair),
m as (select way, r1.family, r1.rel white_rel, r2.rel black_rel, r1.rel+r2.rel combined from w join r r1 on r1.id=wc and r1.color='white' join r r2 on r2.id=bc and r2.color='black' and r2.family=r1.family)
select * from (select way, row_number() over (partition by way order by combined desc, family) rank, family, round(white_rel,6)+0e0 white_rel, round(black_rel,6)+0e0 black_rel, round(combined,6)+0e0 combined, white_rel>0 and black_rel>0 both_positive from m) where rank<=6""")
def q_versus_matchups(spark: SparkSession, d: str) -> DataFrame:
    """The comparison of the first and the last player, read back: families that suit both."""
    item = "array<struct<family: string, white_rel: double, black_rel: double, combined: double, both_positive: boolean>>"
    told = q_versus(spark, d).select(F.from_json("json", f"matchups struct<a_white_b_black: {item}, b_white_a_black: {item}>").alias("a"))
    out = None
    for way in ("a_white_b_black", "b_white_a_black"):
        one = told.select(F.lit(way).alias("way"), F.posexplode(f"a.matchups.{way}").alias("at", "o")).select("way", (F.col("at") + 1).alias("rank"), "o.*")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query()
def q_recommendation_document(spark: SparkSession, d: str) -> DataFrame:
    return _document(spark, d)[1]


def _document(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The clustered players and their recommendation document."""
    view = _stored_games(spark, d)  # read for features, rankings and residuals
    clustered = stage(_clustered(spark, d, view), "clustered")
    return clustered, rankings.recommendation_document(view, clustered, V2_21, dim=openings(spark, d), min_opening_games=MIN_GAMES, vs_min_games=MIN_GAMES, shrinkage_k=SHRINK)


@query()
def q_recommend_answer(spark: SparkSession, d: str) -> DataFrame:
    players, document = _document(spark, d)
    return compare.recommend_answer(players, players.select("username", F.col("n_games").alias("n_games_used")), document, V2_21)


@query()
def q_versus(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last player."""
    view = _stored_games(spark, d)
    players = stage(_clustered(spark, d, view), "players").withColumn("name", F.concat(F.lit("Cluster "), "cluster")).withColumn("blurb", F.lit(""))
    ends = players.agg(F.min("username").alias("lo"), F.max("username").alias("hi"))
    a, b = (players.join(F.broadcast(ends), F.col("username") == F.col(x)).drop("lo", "hi") for x in ("lo", "hi"))
    t = rankings.residual_table(view, players.select("username", F.col("cluster").alias("cohort")), min_games=MIN_GAMES, shrinkage_k=SHRINK)
    return compare.versus(a, b, t, V2_21)


@query()
def q_kmeans(spark: SparkSession, d: str) -> DataFrame:
    rows = _embedded(spark, d).select("id", "features")
    scaled = models.scale(rows, models.fit_scaler(rows))
    return models.assign(scaled, models.fit_kmeans(scaled, 5, restarts=3)).select("id", "cluster", "dist")


@query()
def q_k_sweep(spark: SparkSession, d: str) -> DataFrame:
    return models.k_sweep(_embedded(spark, d).select("id", "features"), 2, 4, restarts=2)


@query()
def q_pca(spark: SparkSession, d: str) -> DataFrame:
    return models.pca(_embedded(spark, d).select("id", "features"), 2)[0].select("id", "pcs")


def _reduced(spark: SparkSession, d: str, k: int) -> DataFrame:
    return models.pca(_embedded(spark, d).select("id", "features"), k)[0].select("id", F.col("pcs").alias("features"))


@query()
def q_gmm_bic(spark: SparkSession, d: str) -> DataFrame:
    return models.gmm_sweep(_reduced(spark, d, 6), 2, 3, restarts=2)


@query()
def q_density_sweep(spark: SparkSession, d: str) -> DataFrame:
    return density.density_sweep(_reduced(spark, d, 6), (10, 25))


@query()
def q_match_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Two halves of the vectors, clustered apart and matched."""
    rows = _embedded(spark, d).select("id", "features")
    halves = [models.fit_kmeans(sampling.split_sample(rows, "id", 2, p), 4, restarts=2) for p in (0, 1)]
    return spark.createDataFrame(models.match_clusters(*halves), "a_cluster int, b_cluster int")


@query(f"""with recursive {TRANSCRIPTS_SQL} select f.o o_orderkey, white_castle, black_castle, white_long, black_long, queens_off, cast(white_pawns as int) white_pawns, cast(black_pawns as int) black_pawns from folds f join off using (o)""")
def q_move_features(spark: SparkSession, d: str) -> DataFrame:
    """The moves of every order's game, as column expressions."""
    m = played(spark, d).withColumn("m", move_features(F.array_join("moves", " ")))
    names = {"white_castle_ply": "white_castle", "black_castle_ply": "black_castle", "white_castle_qside": "white_long", "black_castle_qside": "black_long", "queens_off_ply": "queens_off", "white_early_pawn": "white_pawns", "black_early_pawn": "black_pawns"}
    return m.select("o_orderkey", *(F.col(f"m.{n}").alias(a) for n, a in names.items()))


@query(f"""with recursive {TRANSCRIPTS_SQL} select o o_orderkey, round(white_acpl,6)+0e0 white_acpl, cast(white_blunders as int) white_blunders, cast(white_n_eval as int) white_n_eval, round(black_acpl,6)+0e0 black_acpl, cast(black_blunders as int) black_blunders, cast(black_n_eval as int) black_n_eval from acc where white_n_eval + black_n_eval > 0""")
def q_acpl_fold(spark: SparkSession, d: str) -> DataFrame:
    """The evaluations of every order's game that has some."""
    rows = played(spark, d).select("o_orderkey", accuracy("evals").alias("a")).where("a is not null")
    return rounded(rows.select("o_orderkey", "a.white_acpl", "a.white_blunders", "a.white_n_eval", "a.black_acpl", "a.black_blunders", "a.black_n_eval"))


@query(f"""with {LINES_SQL}, t as (select o_orderkey, unnest(toks[1:c]) tok, unnest(range(1, c + 1)) ply from cut),
f as (select o_orderkey, min(ply) filter (where tok like 'O-O%' and ply % 2 = 1) w, min(ply) filter (where tok like 'O-O%' and ply % 2 = 0) b, bool_or(tok like 'O-O-O%') long_,
  count(*) filter (where regexp_matches(tok, '^[a-z]') and ply <= 20 and ply % 2 = 1) wp, count(*) filter (where regexp_matches(tok, '^[a-z]') and ply <= 20 and ply % 2 = 0) bp from t group by 1)
select o_orderkey, cast(w as int) white_castle, cast(b as int) black_castle, coalesce(w is not null and long_, false) white_long, coalesce(b is not null and long_, false) black_long, cast(case when off <= c then off end as int) queens_off,
cast(coalesce(wp, 0) as int) white_pawns, cast(coalesce(bp, 0) as int) black_pawns from cut left join f using (o_orderkey)""")
def q_board_features(spark: SparkSession, d: str) -> DataFrame:
    """Every order's game replayed on a board, up to the move that isn't legal."""
    names = {"white_castle_ply": "white_castle", "black_castle_ply": "black_castle", "white_castle_qside": "white_long", "black_castle_qside": "black_long", "queens_off_ply": "queens_off", "white_early_pawn": "white_pawns", "black_early_pawn": "black_pawns"}
    return with_board_features(cut_lines(spark, d)).select("o_orderkey", *(F.col(f"mf.{n}").alias(a) for n, a in names.items()))


@query(f"""with {LINES_SQL}, l as (select p_name "name", p_brand, p_partkey % 9 + 1 plies from part where p_partkey % 7 <> 0 and p_partkey % 11 <> 0),
r as (select *, row_number() over (partition by "name" order by plies, p_brand) rn from l) select "name", case when plies % 2 = 1 then 'white' else 'black' end color from r where rn = 1""")
def q_legal_openings(spark: SparkSession, d: str) -> DataFrame:
    """Parts as opening lines; some end in a move that no piece can make, some in a capture that isn't there."""
    lines = F.array(*(F.split(F.lit(text), " ") for text, _ in LINES))
    moves = F.slice(F.get(lines, (F.col("p_size") % len(LINES)).cast("int")), 1, (F.col("p_partkey") % 9 + 1).cast("int"))
    wrong = F.when(F.col("p_partkey") % 7 == 0, " Ke5").when(F.col("p_partkey") % 11 == 0, " axb8").otherwise("")
    return openings_dim(table(spark, d, "part").select(F.col("p_brand").alias("eco"), F.col("p_name").alias("name"), F.concat(F.lit("1. "), F.array_join(moves, " "), wrong).alias("pgn")))


@query(f"""with {_V}, a as (select id i, f from v where id < 4), b as (select id - 4 j, f from v where id between 4 and 11), c as (select i, j, list_distance(a.f, b.f) d from a, b),
p as (select w.j j0, x.j j1, y.j j2, z.j j3, w.d + x.d + y.d + z.d s from c w, c x, c y, c z where w.i = 0 and x.i = 1 and y.i = 2 and z.i = 3 and w.j not in (x.j, y.j, z.j) and x.j not in (y.j, z.j) and y.j <> z.j order by s limit 1)
select cast(unnest([0, 1, 2, 3]) as int) a_cluster, cast(unnest([j0, j1, j2, j3]) as int) b_cluster from p""")
def q_matched_centres(spark: SparkSession, d: str) -> DataFrame:
    """The first four vectors and the eight after them as two runs' centres."""
    centres = {r["id"]: list(r["features"]) for r in _embedded(spark, d).where("id < 12").collect()}
    pairs = models.match_clusters([centres[i] for i in range(4)], [centres[i] for i in range(4, 12)])
    return spark.createDataFrame(pairs, "a_cluster int, b_cluster int")


@query("select split_part(p_name,' ',1) w, count(*) n, count(*) filter (where p_size%2=1) odd from part group by 1")
def q_last_mover(spark: SparkSession, d: str) -> DataFrame:
    """Lines of as many plies as a part's size, White's if odd."""
    line = F.array_join(F.array_repeat(F.lit("Nf3"), F.col("p_size").cast("int")), " ")
    white = F.count_if((last_mover(line) == "white") & (ply_count(line) % 2 == 1))
    return table(spark, d, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w")).agg(F.count("*").alias("n"), white.alias("odd"))


GAME = """[Event "Rated Blitz game"]
[Site "https://lichess.org/abcd1234"]
[White "ann"]
[Black "bob"]
[Result "1-0"]
[UTCDate "2026.04.15"]
[UTCTime "13:42:01"]
[WhiteElo "1500"]
[BlackElo "1600"]
[ECO "C20"]
[Opening "King's Pawn Game: Leonardis Variation"]
[TimeControl "300+3"]
[Termination "Normal"]

1. e4 { [%eval 0.2] } 1... e5 { [%eval 0.3] } 2. d3 { [%eval -2.5] } 2... Nf6 3. Qh5 { [%eval -2.4] } 1-0"""


_KEPT_SQL = f"""{TRANSCRIPTS_SQL}, g as (select o.*, f.*, a.*, queens_off, 700 + o_custkey % 1500 we, 900 + o_orderkey % 1500 be, o_orderkey % 600 + 180 + 40 * (o_orderkey % 10) secs from orders o join folds f on f.o = o_orderkey join acc a on a.o = o_orderkey join off on off.o = o_orderkey),
kept as (select *, case when o_orderpriority like '1%' then 'outoftime' when o_orderstatus not in ('F','O') then 'draw' when last_tok like '%#' then 'mate' else 'resign' end status, case when secs < 480 then 'blitz' when secs < 1500 then 'rapid' else 'classical' end speed from g where we between 800 and 3500 and be between 800 and 3500),
rows_ as (select concat('g', o_orderkey) game_id, 'white' color, concat('C', o_custkey) username, case o_orderstatus when 'F' then 'win' when 'O' then 'loss' else 'draw' end result, we user_rating, be opponent_rating, white_acpl x, white_blunders bl, white_n_eval n, white_castle castle, white_long long_, white_pawns pawns, * from kept
  union all select concat('g', o_orderkey), 'black', concat('D', o_custkey % 97), case o_orderstatus when 'O' then 'win' when 'F' then 'loss' else 'draw' end, be, we, black_acpl, black_blunders, black_n_eval, black_castle, black_long, black_pawns, * from kept)"""


@query(f"""with recursive {_KEPT_SQL} select game_id, color, username, result, cast(user_rating as int) user_rating, cast(opponent_rating as int) opponent_rating, status, speed, epoch_ms(cast(o_orderdate as timestamp)) + 36000000 created_at, cast(n_moves as int) n_moves,
white_n_eval + black_n_eval > 0 has_eval, round(x,6)+0e0 acpl, case when white_n_eval + black_n_eval > 0 then cast(bl as int) end blunders, case when white_n_eval + black_n_eval > 0 then cast(n as int) end n_eval_moves from rows_""")
def q_pgn_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of all orders, read, judged and told from both sides."""
    rows = pgn.games_of(pgn.judged(pgn.extracted(transcripts(spark, d))))
    return rounded(rows.select("game_id", "color", "username", "result", "user_rating", "opponent_rating", "status", "speed", "created_at", "n_moves", "has_eval", "acpl", "blunders", "n_eval_moves"))


@query(f"""with recursive {_KEPT_SQL} select username, count(*) n_games, round(avg(castle),9)+0e0 avg_castle_move, round(avg(case when long_ then 1e0 else 0e0 end) filter (where castle is not null),9)+0e0 pct_queenside_castle,
round(avg(queens_off),9)+0e0 avg_queens_off_move, round(avg(pawns),9)+0e0 early_pawn_pushes, round(sum(x*n) filter (where white_n_eval + black_n_eval > 0)/nullif(sum(n) filter (where white_n_eval + black_n_eval > 0),0),9)+0e0 acpl from rows_ group by 1""")
def q_parsed_features(spark: SparkSession, d: str) -> DataFrame:
    """Players' features from transcripts: moves and evaluations parsed."""
    rows = features.player_features(pgn.games_of(pgn.judged(pgn.extracted(transcripts(spark, d)))), 1)
    return rounded(rows.select("username", "n_games", "avg_castle_move", "pct_queenside_castle", "avg_queens_off_move", "early_pawn_pushes", "acpl"), 9)


@query("""with o as (select *, 700 + o_custkey % 1500 we, 900 + o_orderkey % 1500 be, o_orderkey % 10 k from orders where o_orderkey in (select l_orderkey from lineitem))
select case k when 0 then 'null' when 1 then 'parse:EncodingError' when 2 then 'parse:CommentError' when 3 then 'parse:TagError' when 4 then 'convert:OverflowError' when 5 then 'filtered' when 6 then 'filtered_speed'
else case when we between 800 and 3500 and be between 800 and 3500 then 'kept' else 'filtered_rating' end end reason, count(*) n from o group by 1""")
def q_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of all orders, most of them damaged in one of seven ways by their number: every record has its reason."""
    rows = transcripts(spark, d).withColumn("k", F.regexp_extract("record", r"org/g(\d+)", 1).cast("bigint") % 10)
    r = F.col("record")
    harm = [F.lit("  "), F.concat(r, F.lit(" \ufffd")), F.concat(r, F.lit(" { and so on")), F.replace(r, F.lit('[Result "'), F.lit("[Result ")), F.regexp_replace(r, r'\[WhiteElo "\d+', '[WhiteElo "99999999999'), F.regexp_replace(r, r'\[White "\w+', '[White "?'), F.regexp_replace(r, r'\[TimeControl "[^"]*', '[TimeControl "15+0')]
    for k, damaged in enumerate(harm):
        rows = rows.withColumn("record", F.when(F.col("k") == k, damaged).otherwise(r))
    return pgn.reject_counts(pgn.judged(pgn.quarantined(rows.select("record"))))


@query("""with o as (select * from orders where o_orderkey in (select l_orderkey from lineitem))
select case o_orderstatus when 'F' then '1-0' when 'O' then '0-1' else '1/2-1/2' end result, count(*) n, cast(sum(700 + o_custkey % 1500) as bigint) white, cast(max(900 + o_orderkey % 1500) as bigint) black from o group by 1""")
def q_zstd_frames(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of all orders written as zstd files of many frames, and read back frame by frame."""
    at = frames.write_frames(transcripts(spark, d), frame_records=100)
    rows = pgn.parsed(frames.read_frames(spark, at, task_bytes=1 << 16))
    return rows.groupBy(F.col("Result").alias("result")).agg(F.count("*").alias("n"), F.sum(F.col("WhiteElo").cast("bigint")).alias("white"), F.max(F.col("BlackElo").cast("bigint")).alias("black"))


@query(f"with {SQL} select username, color, family, count(*) n, round(sum(sd),6)+0e0 sum_sd from ann where case when family ilike '%defense%' then 'black' else 'white' end = color group by 1,2,3")
def q_stream_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks kept up by a stream over the games, as files: equal to those of a batch."""
    from .streaming import blocks

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    view = games(spark, d)
    rows = view.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in view.columns and f.name not in ("user_rating", "opponent_rating") else (F.col(f.name) if f.name in view.columns else F.lit(None).cast(f.dataType).alias(f.name)) for f in blocks.schema.GAMES))
    rows.write.parquet(f"{at}/games")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/games")
    blocks.start_blocks(stream, f"{at}/blocks", f"{at}/checkpoint").awaitTermination()
    return rounded(blocks.current_blocks(spark, f"{at}/blocks"))


@query(f"with {SQL}, {_FEATURES_SQL} select {_select({})} from agg")
def q_stream_features(spark: SparkSession, d: str) -> DataFrame:
    """Players' features kept up by a stream over the games, as files: equal to those of a batch."""
    from .streaming import players

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    games(spark, d).write.option("maxRecordsPerFile", 1_000_000).parquet(f"{at}/games")
    landed = spark.read.parquet(f"{at}/games")
    each = -(-len(landed.inputFiles()) // 4)  # some batches, however many files there are
    stream = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", each).parquet(f"{at}/games")
    players.start_features(stream, f"{at}/features", f"{at}/checkpoint", MIN_GAMES).awaitTermination()
    return rounded(players.current_features(spark, f"{at}/features"), 9)


@query("select l_partkey % 20000 k, count(*) n, min(cast(printf('%.4f', (l_partkey % 20000) / 20000e0) as double)) r from lineitem group by 1")
def q_round_binary(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of which half lie at a five in the fifth place, as far as binary ones can."""
    k = F.col("l_partkey") % 20000
    return table(spark, d, "lineitem").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.min(round_binary(k / 20000.0, 4)).alias("r"))


@query(f"with {_DOCUMENT_SQL} select id, color, family, cast(printf('%.4f', resid) as double) + 0e0 resid from d_t")
def q_document_residuals(spark: SparkSession, d: str) -> DataFrame:
    """The residuals of families in the recommendation document."""
    clusters = q_recommendation_document(spark, d).select(F.explode("clusters").alias("c")).select("c.id", F.explode(F.array(*(F.struct(F.lit(s).alias("color"), F.col(f"c.family_residuals.{s}").alias("m")) for s in ("white", "black")))).alias("x"))
    return clusters.select("id", "x.color", F.explode("x.m").alias("family", "resid")).withColumn("resid", F.col("resid") + F.lit(0.0))


@query("""with r as (select p_name "name", p_size%9+1 plies, row_number() over (partition by p_name order by p_size%9+1, p_brand) rn from part) select "name", case when plies%2=1 then 'white' else 'black' end color from r where rn=1""")
def q_stored_openings(spark: SparkSession, d: str) -> DataFrame:
    """The dimension of part names written, replaced by a later one and read back."""
    at = f"{shared_dir(spark)}/openings-{uuid.uuid4().hex}"
    moves = F.slice(F.split(F.lit(LINES[0][0]), " "), 1, (F.col("p_size") % 9 + 1).cast("int"))
    lines = table(spark, d, "part").select(F.col("p_brand").alias("eco"), F.col("p_name").alias("name"), F.array_join(moves, " ").alias("pgn"))
    write_openings(openings_dim(lines.where("eco < 'Brand#3'")), at)
    write_openings(openings_dim(lines), at)
    return stored_openings(spark, at)


@query("""with t as (select o_orderkey % 3 w, o_orderkey % 2 = 0 white, o_orderkey % 1000 secs, o_custkey % 15 inc from orders)
select case w when 0 then '½' when 1 then case when white then 'win' else 'loss' end else case when white then 'loss' else 'win' end end result, concat(cast(secs // 60 as varchar), '+', cast(inc as varchar)) clock, count(*) n from t group by 1, 2""")
def q_display_labels(spark: SparkSession, d: str) -> DataFrame:
    """Results and clocks as a table shows them."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    winner = F.when(key % 3 == 1, "white").when(key % 3 == 2, "black")
    return o.groupBy(display_result(winner, key % 2 == 0).alias("result"), clock_label(key % 1000, F.col("o_custkey") % 15).alias("clock")).agg(F.count("*").alias("n"))


@query("""with t as (select o_orderkey, o_orderkey * power(37, o_orderkey % 9) n from orders),
k as (select *, least(5, case when n < 1024 then 0 when n < power(1024, 2) then 1 when n < power(1024, 3) then 2 when n < power(1024, 4) then 3 when n < power(1024, 5) then 4 else 5 end) u from t)
select o_orderkey, concat(printf('%.1f', n / power(1024, u)), ' ', ['B', 'KB', 'MB', 'GB', 'TB', 'PB'][u + 1]) label from k""")
def q_byte_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", byte_label(F.col("o_orderkey") * F.pow(F.lit(37), F.col("o_orderkey") % 9)).alias("label"))


@query(f"with {_NEAR_SQL} select count(*) k, round(min(avg_rating),9)+0e0 rating_min, round(max(avg_rating),9)+0e0 rating_max, round(avg(avg_rating),9)+0e0 rating_mean from nn")
def q_neighbour_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of the players nearest to the first one."""
    rows, me, name, filled = _near(spark, d)
    players = filled.select(F.col("username").alias("id"), "avg_rating")
    return rounded(neighbours.neighbour_ratings(neighbours.nearest(rows, me, _NEAR, name).join(players, "id")), 9)


@query("""with c as (select c_custkey % 5 g, avg(c_acctbal) bal, avg(c_nationkey) nat from customer group by 1), s as (select s_suppkey % 5 g, avg(s_acctbal) bal, avg(s_nationkey) nat from supplier group by 1)
select c.g a_cluster, s.g b_cluster, f feature, round(case f when 'bal' then c.bal else c.nat end,6)+0e0 a, round(case f when 'bal' then s.bal else s.nat end,6)+0e0 b from c join s on s.g = (c.g + 2) % 5, (select unnest(['bal', 'nat']) f)""")
def q_matched_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Groups of customers beside groups of suppliers, along a pairing."""
    a = compare.cluster_summary(table(spark, d, "customer").select((F.col("c_custkey") % 5).alias("cluster"), F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nat")), ["bal", "nat"])
    b = compare.cluster_summary(table(spark, d, "supplier").select((F.col("s_suppkey") % 5).alias("cluster"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nat")), ["bal", "nat"])
    mapping = a.select(F.col("cluster").alias("a_cluster"), ((F.col("cluster") + 2) % 5).alias("b_cluster"))
    return rounded(compare.matched_summaries(mapping, a, b, ["bal", "nat"]))


@query("""with r as (select *, row_number() over (partition by user_id order by ts desc, event_id) rn from events)
select user_id, count(*) n, min(event_id) low, max(event_id) high from r where rn <= greatest(20, least(200, user_id % 240)) group by 1""")
def q_latest_games(spark: SparkSession, d: str) -> DataFrame:
    """Each user's latest events, as many as the user asks for, within bounds."""
    e = table(spark, d, "events").select(F.col("user_id").alias("username"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"), F.col("event_id").alias("game_id"))
    return compare.latest_games(e, F.col("username") % 240).groupBy(F.col("username").alias("user_id")).agg(F.count("*").alias("n"), F.min("game_id").alias("low"), F.max("game_id").alias("high"))


@query("""with o as (select *, 700 + o_custkey % 1500 we, 900 + o_orderkey % 1500 be, o_orderkey % 7 k, o_orderkey in (select l_orderkey from lineitem) there from orders)
select case when k in (0, 1, 2, 3) then 'filtered' when k = 4 then 'filtered_speed' when we between 1200 and 1900 and be between 1200 and 1900 then 'kept' else 'filtered_rating' end reason, count(*) n from o where there group by 1""")
def q_filters(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts that are unrated, of no code, of no clock, too short or too fast by their number; and a narrower band of ratings."""
    rows = transcripts(spark, d).withColumn("k", F.regexp_extract("record", r"org/g(\d+)", 1).cast("bigint") % 7)
    r = F.col("record")
    made = [F.replace(r, F.lit('[ECO "'), F.lit('[Rated "False"]\n[ECO "')), F.replace(r, F.lit('[ECO "B20"]'), F.lit('[ECO ""]')), F.regexp_replace(r, r'\[TimeControl "[^"]*', '[TimeControl "-'), F.regexp_replace(r, r"(?s)\n\n.*", "\n\n1. e4 e5 2. Nf3 1-0"), F.regexp_replace(r, r'\[TimeControl "[^"]*', '[TimeControl "20+1')]
    for k, other in enumerate(made):
        rows = rows.withColumn("record", F.when(F.col("k") == k, other).otherwise(r))
    return pgn.reject_counts(pgn.judged(pgn.extracted(rows.select("record")), min_elo=1200, max_elo=1900))


def _headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A header before the rows of a task."""
    yield pa.RecordBatch.from_arrays([pa.array(["eco\tname\tpgn"])], ["value"])
    yield from batches


@query("""with r as (select p_name "name", p_size%9+1 plies, row_number() over (partition by p_name order by p_size%9+1, p_brand) rn from part) select "name", case when plies%2=1 then 'white' else 'black' end color from r where rn=1""")
def q_openings_tsv(spark: SparkSession, d: str) -> DataFrame:
    """Part names as opening lines written as tab-separated text, with lines that lack fields, and read back."""
    at = f"{shared_dir(spark)}/openings-{uuid.uuid4().hex}"
    moves = F.array_join(F.slice(F.split(F.lit(LINES[0][0]), " "), 1, (F.col("p_size") % 9 + 1).cast("int")), " ")
    lines = table(spark, d, "part").select(F.concat_ws("\t", "p_brand", "p_name", moves).alias("value"))
    short = table(spark, d, "nation").select("n_name")
    # A header stands on top of each file.
    spread = lines.unionByName(short.toDF("value")).repartition(4)
    spread.mapInArrow(_headed, "value string").write.text(at)
    return openings_dim(read_openings(spark, at))


@query("""with m as (select var_pop(l_quantity) a, var_pop(l_tax * 400) c, covar_pop(l_quantity, l_tax * 400) b from lineitem), e as (select (a + c) / 2 mid, sqrt(power((a - c) / 2, 2) + b * b) half from m)
select unnest([1, 2]) component, round(unnest([(mid + half) / (2 * mid), (mid - half) / (2 * mid)]), 6) + 0e0 share from e""")
def q_pca_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of two components' variance, against the closed form of a 2x2 matrix."""
    rows = models.vectors(table(spark, d, "lineitem").withColumn("t", F.col("l_tax") * 400), "l_orderkey", ["l_quantity", "t"])
    shares = models.pca(rows, 2)[1]
    return spark.createDataFrame([(k + 1, round(s, 6) + 0.0) for k, s in enumerate(shares)], "component int, share double")


_MODEL = {"columns": _STYLE, "scaler": [(100.0, 200.0), (12.0, 3.0), (0.3, 0.1)], "centres": [[0.0, 0.0, 0.0], [1.0, -1.0, 0.5], [-1.0, 0.5, 1.0]]}
_EVERYONE = _FEATURES_SQL.replace(f" having count(*)>={MIN_GAMES}", "")


@query(f"""with {SQL}, {_EVERYONE}, s as (select username, [(avg_rating - 100e0) / 200e0, (avg_moves - 12e0) / 3e0, (draw_rate - 0.3e0) / 0.1e0] f from agg),
c as (select unnest([0, 1, 2]) k, unnest({_MODEL["centres"]}) m), n as (select username, k, list_distance(f, cast(m as double[])) d, row_number() over (partition by username order by list_distance(f, cast(m as double[])), k) rn from s, c)
select username, cast(k as int) "cluster", round(d, 6) + 0e0 dist from n where rn = 1""")
def q_live_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every player placed by a model that was stored and loaded again."""
    at = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    models.save_model(spark, at, _MODEL["columns"], _MODEL["scaler"], _MODEL["centres"], {f"mean_{c}": 0.5 for c in features.FROM_ALL})
    return rounded(features.live_profile(games(spark, d), models.load_model(spark, at)).select("username", "cluster", "dist"))


def _told(rows: DataFrame, name: Column, opponent: Column, rating: Column, game: Column) -> DataFrame:
    """Rows of games with these columns, the others null."""
    known = {"username": name, "opponent_username": opponent, "opponent_rating": rating, "game_id": game}
    return rows.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in GAMES))


@query("""with g as (select o_orderkey k, concat('C', o_custkey) u, concat('D', o_custkey % 89) o, o_orderkey % 3000 r, o_custkey % 10 = 0 top from orders),
names as (select distinct lower(o) n from g where top and r < 2200 and r <> 0)
select 'first' stage, count(*) games, count(distinct u) players from g where top union all select 'second', count(*), count(distinct n) from names join g on lower(g.o) = n""")
def q_two_stages(spark: SparkSession, d: str) -> DataFrame:
    """The games of every tenth customer, then those of all of their weaker opponents."""
    o = table(spark, d, "orders")
    custom, rival = F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("D"), F.col("o_custkey") % 89)
    game, rating = F.concat(F.lit("g"), "o_orderkey"), F.col("o_orderkey") % 3000
    first = _told(o.where("o_custkey % 10 = 0"), custom, rival, rating, game)
    every = _told(o, F.lower(rival), custom, F.lit(1500), game)
    both = feed.collected(first.select(F.col("username").alias("name")).distinct(), first, 2**31 - 1, lambda names: every.join(names.select(F.col("name").alias("username")), "username").select(first.columns))
    stage_ = F.when(F.startswith("username", F.lit("C")), "first").otherwise("second")
    return both.groupBy(stage_.alias("stage")).agg(F.count("*").alias("games"), F.countDistinct("username").alias("players"))


@query("select unnest([0, 40, 80]) \"skip\", 40 n, 0 again from (select 1)")
def q_sampled_games(spark: SparkSession, d: str) -> DataFrame:
    """Three samples of the kept games, one after another: none is in two of them."""
    judged = stage(pgn.judged(pgn.extracted(transcripts(spark, d))).where("reject is null"), "judged")
    out = None
    for skip in (0, 40, 80):
        one = pgn.sample_games(judged, 40, skip=skip).select("Site", F.lit(skip).alias("skip"))
        out = one if out is None else out.unionByName(one)
    seen = out.groupBy("Site").agg(F.count("*").alias("times"))
    return out.join(seen, "Site").groupBy("skip").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("times") > 1).cast("int").alias("again"))
