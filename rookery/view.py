"""The driver's tables seen as games: each line item is one between a customer
(White) and a supplier (Black). And the same view as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First words of part names that stand for openings of White's choice; others are Black's.
WHITE_WORDS = ("red", "green", "big", "hot")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with what `games` needs of their orders, customers, suppliers and parts. Orders meet their customers before line items, of which there are more, and parts come first, while rows are narrow."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_tax", "l_discount")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).drop("o_orderkey", "c_custkey", "s_suppkey", "p_partkey")


def games(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Two games a line item, of all `lines` or of those that are given (stored ones)."""
    rows = lines(spark, d) if rows is None else rows

    def side(color: str, name: Column, own: str, other: str, wins: str, loses: str, cohort: Column) -> Column:
        result = F.when(F.col("l_returnflag") == wins, "win").when(F.col("l_returnflag") == loses, "loss").otherwise("draw")
        return F.struct(F.lit(color).alias("color"), name.alias("username"), (F.col(own) / 10.0).alias("user_rating"), (F.col(other) / 10.0).alias("opponent_rating"), result.alias("result"), cohort.alias("segment"))

    white = side("white", F.concat(F.lit("C"), "o_custkey"), "c_acctbal", "s_acctbal", "R", "A", F.col("c_mktsegment"))
    black = side("black", F.concat(F.lit("S"), "l_suppkey"), "s_acctbal", "c_acctbal", "A", "R", F.concat(F.lit("N"), "s_nationkey"))
    status = F.when(F.startswith("o_orderpriority", F.lit("1")), "mate").when(F.startswith("o_orderpriority", F.lit("2")), "outoftime").when(F.startswith("o_orderpriority", F.lit("3")), "draw").otherwise("resign")
    eco = F.concat(F.substring(F.lit("ABCDE"), (F.col("p_size") % 5 + 1).cast("int"), F.lit(1)), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"))
    return rows.withColumn("me", F.explode(F.array(white, black))).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("game_id"), "me.*", status.alias("status"), (F.col("l_quantity") * 2.0).alias("n_moves"),
        eco.alias("opening_eco"), F.replace("p_name", F.lit(" "), F.lit(": ")).alias("opening_name"),
        (F.col("l_tax") >= 0.04).alias("has_eval"), (F.col("l_discount") * 1000.0).alias("acpl"), F.col("l_linenumber").alias("n_eval_moves"), (F.col("l_linenumber") % 3).alias("blunders"),
        F.nullif("l_linenumber", F.lit(1)).alias("castle_ply"), (F.col("l_linenumber") > 3).alias("castle_qside"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("queens_off_ply"), F.col("l_linenumber").alias("early_pawn"),
    )


def openings(spark: SparkSession, d: str) -> DataFrame:
    """(name, color): a dimension of the first words of part names."""
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    return table(spark, d, "part").select(word.alias("name")).distinct().select("name", F.when(F.col("name").isin(*WHITE_WORDS), "white").otherwise("black").alias("color"))


#: Moves that the made transcripts consist of: castling both ways, pawns, queens that come, go and are taken, a mate.
TOKENS = ("e4", "d5", "Nf3", "Qd3", "Qxd5", "exd5", "O-O", "O-O-O", "Bxd8", "a8=Q", "Qd1xd8", "Qh7#")
#: Four moves of a line item, by these keys; and their evaluations, none for one of five.
_KEYS = ("l_partkey", "l_suppkey", "l_partkey + l_linenumber", "l_suppkey + l_orderkey")


def played(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a game (o_orderkey, moves, evals), of the four moves of each of its lines."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    tokens = F.array(*map(F.lit, TOKENS))
    moves = F.array(*(F.get(tokens, F.expr(f"cast(({k}) % {len(TOKENS)} as int)")) for k in _KEYS))
    worth = [F.expr(f"cast((({k}) * 37 + l_linenumber * {i}) % 2401 - 1200 as int)") for i, k in enumerate(_KEYS)]
    evals = F.array(*(F.when((w % 5 != 0) & (F.col("l_orderkey") % 3 == 0), w) for w in worth))
    rows = line.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", moves.alias("m"), evals.alias("e")).alias("x"))
    whole = rows.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("x")).alias("x"))  # an order's few lines
    return whole.select("o_orderkey", F.flatten("x.m").alias("moves"), F.flatten("x.e").alias("evals"))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """`record`: the text of each order's game, evaluations as comments."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy.MM.dd").alias("day"))
    rows = played(spark, d).join(orders, "o_orderkey")
    ply = F.transform("moves", lambda m, i: F.concat(F.when(i % 2 == 0, F.concat((i / 2 + 1).cast("int").cast("string"), F.lit(". "))).otherwise(F.lit("")), m, F.coalesce(F.concat(F.lit(" { [%eval "), F.format_number(F.get("evals", i) / 100.0, 2), F.lit("] }")), F.lit(""))))
    result = F.when(F.col("o_orderstatus") == "F", "1-0").when(F.col("o_orderstatus") == "O", "0-1").otherwise("1/2-1/2")
    tags = {
        "Event": F.lit("Rated game"), "Site": F.concat(F.lit("https://lichess.org/g"), "o_orderkey"), "White": F.concat(F.lit("C"), "o_custkey"), "Black": F.concat(F.lit("D"), F.col("o_custkey") % 97),
        "Result": result, "UTCDate": F.col("day"), "UTCTime": F.lit("10:00:00"), "WhiteElo": F.lit(700) + F.col("o_custkey") % 1500, "BlackElo": F.lit(900) + F.col("o_orderkey") % 1500,
        "ECO": F.lit("B20"), "Opening": F.lit("Sicilian Defense: Bowdler Attack"), "TimeControl": F.concat(F.col("o_orderkey") % 600 + 180, F.lit("+"), F.col("o_orderkey") % 10), "Termination": F.when(F.startswith("o_orderpriority", F.lit("1")), "Time forfeit").otherwise("Normal"),
    }
    head = F.concat_ws("\n", *(F.concat(F.lit(f'[{t} "'), c.cast("string"), F.lit('"]')) for t, c in tags.items()))
    return rows.select(F.concat(head, F.lit("\n\n"), F.array_join(ply, " "), F.lit(" "), result).alias("record"))


#: The same games as SQL: t(o, ply, tok, e), and what folds over them say.
TRANSCRIPTS_SQL = f"""
lines as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 nth from lineitem),
k as ({" union all ".join(f"select l_orderkey o, cast(nth * 4 + {i + 1} as int) ply, ({key}) % {len(TOKENS)} pos, (({key}) * 37 + l_linenumber * {i}) % 2401 - 1200 w from lines" for i, key in enumerate(_KEYS))}),
t as (select o, ply, {list(TOKENS)}[pos + 1] tok, case when w % 5 <> 0 and o % 3 = 0 then w end e from k),
loss as (select o, ply, greatest(0, least(1000, case when ply % 2 = 1 then 1 else -1 end * (coalesce(lag(e) over (partition by o order by ply), 20) - e))) + e * 0 x from t),
acc as (select o, avg(x) filter (where ply % 2 = 1) white_acpl, count(*) filter (where ply % 2 = 1 and x >= 200) white_blunders, count(x) filter (where ply % 2 = 1) white_n_eval,
  avg(x) filter (where ply % 2 = 0) black_acpl, count(*) filter (where ply % 2 = 0 and x >= 200) black_blunders, count(x) filter (where ply % 2 = 0) black_n_eval from loss group by o),
queens(o, ply, w, b, gone) as (select distinct o, 0, ['d1'], ['d8'], cast(null as int) from t
  union all select o, ply, w, b, case when gone is null and len(w) + len(b) = 0 then ply else gone end from (
    select o, ply, case when ply % 2 = 1 then own else other end w, case when ply % 2 = 1 then other else own end b, gone from (
      select o, ply, gone, case when tok like 'Q%' then list_append([q for q in mine if q <> coalesce(leaves, '')], dest) when contains(tok, '=Q') then list_append(mine, dest) else mine end own,
        case when contains(tok, 'x') then [q for q in theirs if q <> dest] else theirs end other from (
        select *, [q for q in mine if contains(q, origin)][-1] leaves from (
          select t.o, t.ply, t.tok, gone, regexp_extract(tok, '([a-h][1-8])(=[QRBN])?[+#]?$', 1) dest, regexp_extract(tok, '^Q([a-h]?[1-8]?)x?[a-h][1-8]', 1) origin,
            case when t.ply % 2 = 1 then w else b end mine, case when t.ply % 2 = 1 then b else w end theirs from queens join t on t.o = queens.o and t.ply = queens.ply + 1))))),
folds as (select t.o, count(*) n_moves, min(ply) filter (where tok like 'O-O%' and ply % 2 = 1) white_castle, coalesce(arg_min(tok, ply) filter (where tok like 'O-O%' and ply % 2 = 1) like 'O-O-O%', false) white_long,
  min(ply) filter (where tok like 'O-O%' and ply % 2 = 0) black_castle, coalesce(arg_min(tok, ply) filter (where tok like 'O-O%' and ply % 2 = 0) like 'O-O-O%', false) black_long,
  count(*) filter (where ply <= 20 and ply % 2 = 1 and regexp_matches(tok, '^[a-z]')) white_pawns, count(*) filter (where ply <= 20 and ply % 2 = 0 and regexp_matches(tok, '^[a-z]')) black_pawns,
  arg_max(tok, ply) last_tok from t group by t.o),
off as (select o, max(gone) queens_off from queens group by o)
"""

#: Games that are legal throughout, with the ply after which no queen is left: castling short, an early and a late
#: exchange, castling long, and two white queens of which the older one moves on.
LINES = (
    ("e4 e5 Nf3 Nc6 Bb5 a6 Ba4 Nf6 O-O Be7 Re1 b5 Bb3 d6 c3 O-O h3 Na5 Bc2 c5 d4 Qc7", None),
    ("e4 d5 exd5 Qxd5 Nc3 Qe5+ Qe2 Qxe2+ Bxe2 Nc6", 9),
    ("e4 e5 Nf3 Nc6 Bb5 Nf6 O-O Nxe4 d4 Nd6 Bxc6 dxc6 dxe5 Nf5 Qxd8+ Kxd8 h3", 16),
    ("d4 d5 Nc3 Nf6 Bf4 Bf5 Qd2 Nc6 O-O-O Qd7 f3 O-O-O e3 h6", None),
    ("h4 g5 hxg5 h6 gxh6 Nf6 h7 Rg8 h8=Q Nc6 e4 d6 Qf3 Rxh8 Rxh8 Bg4 Qxf6 exf6 Rxf8+ Kxf8 Nc3 Qe8 Nd5 Qxe4+ Be2 Qxe2+ Nxe2 f5", 27),
)


def cut_lines(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, moves): each order plays one of LINES, with a king's leap that is never legal somewhere in it or at its end."""
    lines = F.array(*(F.split(F.lit(text), " ") for text, _ in LINES))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.get(lines, (F.col("o_orderkey") % len(LINES)).cast("int")).alias("line"))
    at = (F.col("o_custkey") % (F.size("line") + 4)).cast("int")
    moves = F.concat(F.slice("line", 1, at), F.array(F.lit("Ke5")), F.slice("line", at + 1, F.size("line")))
    return rows.select("o_orderkey", F.array_join(moves, " ").alias("moves"))


#: The same games as SQL: cut(o_orderkey, toks, off, c), c legal moves.
LINES_SQL = f"""
known as (select * from (values {", ".join(f"({i}, {text.split()}, {'null' if off is None else off})" for i, (text, off) in enumerate(LINES))}) v(line, toks, off)),
cut as (select o_orderkey, toks, off, least(o_custkey % (len(toks) + 4), len(toks)) c from orders join known on line = o_orderkey % {len(LINES)})
"""

_WORDS = ", ".join(f"'{w}'" for w in WHITE_WORDS)
SQL = f"""
base as (select l.l_orderkey*10+l.l_linenumber game_id, o.o_custkey, l.l_suppkey, l.l_quantity q, l.l_returnflag rf, o.o_orderpriority op, l.l_tax, l.l_discount,
  l.l_linenumber ln, c.c_acctbal, c.c_mktsegment, s.s_acctbal, s.s_nationkey, p.p_partkey, p.p_size, p.p_name
  from lineitem l join orders o on l.l_orderkey=o.o_orderkey join customer c on o.o_custkey=c.c_custkey join supplier s on l.l_suppkey=s.s_suppkey join part p on l.l_partkey=p.p_partkey),
common as (select *, case when op like '1%' then 'mate' when op like '2%' then 'outoftime' when op like '3%' then 'draw' else 'resign' end status, q*2e0 n_moves,
  concat(substr('ABCDE', cast(p_size%5 as int)+1, 1), lpad(cast(p_partkey%100 as varchar), 2, '0')) opening_eco, replace(p_name, ' ', ': ') opening_name,
  l_tax>=0.04e0 has_eval, l_discount*1000e0 acpl, ln n_eval_moves, ln%3 blunders, nullif(ln,1) castle_ply, ln>3 castle_qside, case when q>25 then q end queens_off_ply, ln early_pawn from base),
games as (select concat('C', cast(o_custkey as varchar)) username, 'white' color, case rf when 'R' then 'win' when 'A' then 'loss' else 'draw' end result, c_acctbal/10e0 user_rating, s_acctbal/10e0 opponent_rating, c_mktsegment segment, * from common
  union all select concat('S', cast(l_suppkey as varchar)), 'black', case rf when 'A' then 'win' when 'R' then 'loss' else 'draw' end, s_acctbal/10e0, c_acctbal/10e0, concat('N', cast(s_nationkey as varchar)), * from common),
ann as (select *, case result when 'win' then 1e0 when 'draw' then 0.5e0 else 0e0 end - 1e0/(1e0+power(10e0,(opponent_rating-user_rating)/400e0)) sd,
  substr(opening_eco,1,1) el, cast(substr(opening_eco,2,2) as int) en, trim(split_part(opening_name,':',1)) family,
  case when split_part(p_name,' ',1) in ({_WORDS}) then 'white' else 'black' end owner from games)
"""
