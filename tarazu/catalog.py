"""The ledger engine's queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions import dates, merchants, money, narration
from .operators import insights, linking, patterns, reconcile, report
from .plans import evaluation, ledger as labels, question
from .plans.query import Period, Query, count, evidence, select, top, total
from .sinks import export, payload
from .session import shuffled, written
from .sources import adapter, load, tables, words
from .streaming import budget

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE: dict[str, str] = {}

JANUARY = Period(date(2024, 1, 5), date(2024, 1, 20), "part of January")

#: The adapter's tables in SQL.
LEDGER = """e as (select *, cast(json_extract_string(props, '$.k') as bigint) k from events),
l as (select 'acct-' || user_id statement_id, user_id pos, event_id seq, event_id "row", cast(ts as date) "date",
  case when event_type in ('signup', 'error') then 'credit' else 'debit' end direction, 'm' || (k % 8) "name", 'c' || (k % 3) category,
  cast((floor(value / 50) + 1) * 5000 as bigint) amount, cast(round(value * 100) as bigint) exact, user_id % 4 = 0 on_card,
  case k % 8 when 0 then 'card bill' when 1 then 'person' when 2 then 'unknown' else 'merchant' end kind,
  case k % 5 when 0 then 'lexicon' when 1 then 'vpa' when 2 then 'prefix' when 3 then 'segmented' else 'raw' end source from e)"""
BOOKS = (
    LEDGER
    + """,
t as (select *, case when seq % 5 <> 0 then 100000 + cum + case when seq % 97 = 0 then 100 else 0 end end balance from
  (select statement_id, pos, seq, "row", "date", direction, exact amount, on_card, cast(sum(case when direction = 'credit' then exact else -exact end) over (partition by statement_id order by seq) as bigint) cum from l)),
s0 as (select statement_id, pos, on_card, cast(coalesce(sum(exact) filter (direction = 'debit'), 0) as bigint) d, cast(coalesce(sum(exact) filter (direction = 'credit'), 0) as bigint) c from l group by all),
s as (select statement_id, pos, on_card, d, c, cast(100000 as bigint) opening, 100000 + c - d + case when pos % 7 = 0 then 50 else 0 end closing,
  pos % 2 = 0 and pos % 3 = 0 tautological,
  case when pos % 3 = 0 then d + case when pos % 11 = 0 then 1 else 0 end end stated_debits, case when pos % 3 = 0 then c + case when pos % 13 = 0 then 1 else 0 end end stated_credits,
  cast(50000 as bigint) previous, c + case when pos % 17 = 0 then 5 else 0 end payments, case when pos % 19 <> 0 then d end purchases, case when pos % 8 = 0 then cast(0 as bigint) end fees,
  50000 - c + d + case when pos % 12 = 0 then 60 else 0 end + case when pos % 16 = 0 then 500 else 0 end due from s0)"""
)
CHAIN = (
    BOOKS
    + """,
a as (select *, last_value(case when balance is not null then {'b': balance, 'c': cum} end ignore nulls) over (partition by statement_id order by seq rows between unbounded preceding and 1 preceding) anchor from t),
f as (select statement_id, seq, "row", cast(coalesce(anchor.b - anchor.c, 100000) + cum as bigint) expected, balance from a),
faults as (select statement_id, seq, "row", expected, cast(balance as bigint) actual, cast(balance - expected as bigint) delta from f where balance <> expected)"""
)
REFUNDS = (
    LEDGER
    + """,
cr as (select *, row_number() over (partition by statement_id, "name", amount order by seq) rn from l where direction = 'credit'),
g as (select statement_id, "name", amount, list({'d': "date", 's': seq} order by "date", seq) ds from l where direction = 'debit' group by all),
step as (select statement_id, "name", amount, cast(0 as bigint) rn, cast([] as bigint[]) used, cast(null as bigint) debit_seq, cast(null as bigint) credit_seq, cast(null as date) debit_date, cast(null as date) credit_date from g
  union all
  select s.statement_id, s."name", s.amount, cr.rn, case when p.pick is null then s.used else list_append(s.used, p.pick.s) end, p.pick.s, cr.seq, p.pick.d, cr."date"
  from step s join cr on cr.statement_id = s.statement_id and cr."name" = s."name" and cr.amount = s.amount and cr.rn = s.rn + 1
  join g on g.statement_id = s.statement_id and g."name" = s."name" and g.amount = s.amount,
  lateral (select list_filter(g.ds, lambda x: not list_contains(s.used, x.s) and date_diff('day', x.d, cr."date") between 0 and 90)[1] pick) p),
refunds as (select statement_id, "name", amount, debit_seq, credit_seq, debit_date, credit_date, cast(date_diff('day', debit_date, credit_date) as integer) lag_days from step where debit_seq is not null)"""
)
DUPLICATES = (
    REFUNDS
    + """,
db as (select l.*, case when date_diff('day', lag("date") over w, "date") <= 3 then 0 else 1 end nw from l where direction = 'debit' window w as (partition by statement_id, "name", amount order by "date", seq)),
cl as (select *, sum(nw) over (partition by statement_id, "name", amount order by "date", seq) cluster from db),
duplicates as (select cl.statement_id, cl."name", cl.amount, count(*) n, min("date") first_date, max("date") last_date, count(r.debit_seq) refunded,
  cast(cl.amount * greatest(count(*) - 1 - count(r.debit_seq), 0) as bigint) exposure
  from cl left join refunds r on r.statement_id = cl.statement_id and r.debit_seq = cl.seq group by cl.statement_id, cl."name", cl.amount, cl.cluster having count(*) >= 2)"""
)
RECURRING = (
    LEDGER
    + """,
ao as (select statement_id, max("date") as_of from l group by 1),
pr as (select statement_id, "name", count(*) n, min(amount) least, max(amount) most, cast(round_even(median(amount), 0) as bigint) typical, arg_min(category, "row") category from l where direction = 'debit' group by 1, 2),
dd as (select distinct statement_id, "name", "date" from l where direction = 'debit'),
gp as (select *, date_diff('day', lag("date") over (partition by statement_id, "name" order by "date"), "date") gap from dd),
pc as (select statement_id, "name", count(*) nd, cast(round_even(median(gap), 0) as integer) spacing, min(gap) shortest, max(gap) longest, max("date") last_date from gp group by 1, 2),
recurring as (select statement_id, "name", category, n, typical, spacing,
  case when abs(spacing - 7) <= 3 then 'weekly' when abs(spacing - 14) <= 3 then 'fortnightly' when abs(spacing - 30) <= 6 then 'monthly' when abs(spacing - 91) <= 18.2 then 'quarterly' when abs(spacing - 365) <= 73 then 'yearly' else 'every ' || spacing || 'd' end cadence,
  last_date, date_diff('day', last_date, as_of) <= 1.5 * spacing active, cast(round_even(typical * 365 / spacing, 0) as bigint) annualised
  from pc join pr using (statement_id, "name") join ao using (statement_id)
  where nd >= 3 and spacing > 0 and abs(shortest - spacing) <= greatest(4, spacing * 0.25) and abs(longest - spacing) <= greatest(4, spacing * 0.25) and case when least = 0 then most = 0 else most <= least * 1.25 end)"""
)


def _pairs(name: str, outs: str, ins: str, low: int, high: int, across: bool) -> str:
    """Greedy nearest pairing as a recursive query; outs and ins are conditions, their orders stand after 'order by'."""
    other = "and x.i <> o.statement_id" if across else ""
    return f"""
{name}_o as (select *, row_number() over (partition by exact {outs.split('|')[1]}) rn from l where {outs.split('|')[0]}),
{name}_g as (select exact, list({{'i': statement_id, 's': seq, 'd': "date"}} {ins.split('|')[1]}) xs from l where {ins.split('|')[0]} group by exact),
{name}_p as (select exact, cast(0 as bigint) rn, cast([] as bigint[]) used, cast(null as varchar) o_id, cast(null as bigint) o_seq, cast(null as varchar) i_id, cast(null as bigint) i_seq, cast(null as bigint) lag from {name}_g
  union all
  select p.exact, o.rn, case when m.best is null then p.used else list_append(p.used, m.best.s) end, o.statement_id, o.seq, m.best.i, m.best.s, cast(date_diff('day', o."date", m.best.d) as bigint)
  from {name}_p p join {name}_o o on o.exact = p.exact and o.rn = p.rn + 1 join {name}_g g on g.exact = p.exact,
  lateral (select list_min([{{'k': abs(date_diff('day', o."date", g.xs[j].d)), 'j': j, 'i': g.xs[j].i, 's': g.xs[j].s, 'd': g.xs[j].d}} for j in range(1, len(g.xs) + 1)
    if list_contains(list_transform([g.xs[j]], lambda x: not list_contains(p.used, x.s) and date_diff('day', o."date", x.d) between {low} and {high} {other}), true)]) best) m),
{name} as (select o_id, o_seq, i_id, i_seq, exact amount, cast(lag as integer) lag_days from {name}_p where i_seq is not null)"""


TRANSFERS = LEDGER + "," + _pairs("transfers", "direction = 'debit' and not on_card|order by \"date\", \"row\", pos, seq", "direction = 'credit' and not on_card|order by pos, seq", 0, 3, True)
REPAYMENTS = TRANSFERS + "," + _pairs("repayments", "direction = 'debit' and not on_card and kind = 'card bill'|order by pos, \"date\", \"row\", seq", "direction = 'credit' and on_card|order by pos, seq", -2, 7, False)


def query(sql: str | None = None, recursive: bool = False) -> Callable[[Run], Run]:
    def keep(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = ("with recursive " if recursive else "with ") + sql
        return f

    return keep


# selection and aggregates


@query(LEDGER + """ select cast(sum(amount) as bigint) amount, count(*) n from l where "name" = 'm3' and direction = 'debit' and "date" between '2024-01-05' and '2024-01-20'""")
def total_by_filter(spark, sf_dir):
    return total(adapter.ledger(spark, sf_dir), Query("total", merchant="m3", direction="debit", period=JANUARY))


@query(LEDGER + """ select cast(coalesce(sum(amount), 0) as bigint) amount, count(*) n from l where category = 'c1' and direction = 'credit'""")
def count_by_filter(spark, sf_dir):
    return count(adapter.ledger(spark, sf_dir), Query("count", category="c1", direction="credit"))


@query(LEDGER + """ select "name", cast(sum(amount) as bigint) amount, count(*) n from l where direction = 'debit' group by 1 order by 2 desc, min({'d': "date", 's': statement_id, 'r': "row", 'q': seq}) limit 5""")
def top_merchants(spark, sf_dir):
    return top(adapter.ledger(spark, sf_dir), Query("top", direction="debit"))


@query(LEDGER + """ select statement_id, seq, "name", amount from l where category = 'c2' and on_card and direction = 'debit'""")
def select_rows(spark, sf_dir):
    return select(adapter.ledger(spark, sf_dir), Query("total", category="c2", on_card=True, direction="debit")).select("statement_id", "seq", "name", "amount")


@query(LEDGER + """, t5 as (select "name" from l where direction = 'debit' group by 1 order by sum(amount) desc limit 5) select statement_id, seq from l where direction = 'debit' and "name" in (select "name" from t5)""")
def evidence_semi(spark, sf_dir):
    return evidence(adapter.ledger(spark, sf_dir), Query("top", direction="debit")).select("statement_id", "seq")


ROLLUP = LEDGER + """, r as (select "name", cast(coalesce(sum(amount) filter (direction = 'debit'), 0) as bigint) debits, cast(coalesce(sum(amount) filter (direction = 'credit'), 0) as bigint) credits,
count(*) n, count(*) filter (direction = 'debit') n_debits, arg_min(category, {'d': "date", 's': statement_id, 'r': "row", 'q': seq}) category from l group by 1),
c as (select category, cast(sum(debits) as bigint) debits, cast(sum(credits) as bigint) credits, cast(sum(n) as bigint) n, cast(sum(n_debits) as bigint) n_debits, count(*) merchants from r group by 1)"""


@query(ROLLUP + " select *, debits + credits turnover, credits - debits net from r")
def merchant_rollup(spark, sf_dir):
    return insights.merchant_rollup(adapter.ledger(spark, sf_dir))


@query(LEDGER + """ select "name", source, count(*) n from l group by 1, 2""")
def merchant_sources(spark, sf_dir):
    return insights.merchant_sources(adapter.ledger(spark, sf_dir))


@query(ROLLUP + " select * from c")
def category_rollup(spark, sf_dir):
    return insights.category_rollup(adapter.ledger(spark, sf_dir))


@query(ROLLUP + " select category, debits, n_debits n, cast(debits * 100 // (select sum(debits) from c) as bigint) percent from c where debits > 0")
def category_share(spark, sf_dir):
    return insights.category_share(adapter.ledger(spark, sf_dir))


@query(LEDGER + " select kind, count(*) n, count(*) filter (source in ('lexicon', 'vpa', 'prefix')) confident, count(*) filter (kind <> 'unknown') classified from l group by 1")
def coverage_by_kind(spark, sf_dir):
    return insights.coverage(adapter.ledger(spark, sf_dir))


@query(LEDGER + """ select statement_id account, "date", "row", seq, direction, amount, "name" from l where not on_card""")
def merged_ledger(spark, sf_dir):
    return linking.merged(adapter.ledger(spark, sf_dir))


# reconciliation


def _books(spark, sf_dir):
    rows = adapter.ledger(spark, sf_dir)
    return adapter.transactions(rows), adapter.statements(rows)


@query(BOOKS + " select statement_id, opening, cast(closing as bigint) closing, c credits, d debits, cast(opening + c - d as bigint) computed, cast(closing - (opening + c - d) as bigint) delta from s")
def reconcile_totals(spark, sf_dir):
    return reconcile.totals(*_books(spark, sf_dir))


@query(CHAIN + " select * from faults")
def chain_faults(spark, sf_dir):
    return reconcile.chain_faults(*_books(spark, sf_dir))


STATED = """ (select statement_id, 'stated-debits' kind, d expected, cast(stated_debits as bigint) actual from s where stated_debits <> d union all select statement_id, 'stated-credits', c, cast(stated_credits as bigint) from s where stated_credits <> c)"""


@query(BOOKS + " select * from " + STATED)
def stated_totals_check(spark, sf_dir):
    return reconcile.stated_totals(*_books(spark, sf_dir))


@query(BOOKS + """, x as (select statement_id, 'summary' kind, previous - payments + purchases + coalesce(fees, 0) expected, due actual from s where on_card
union all select statement_id, 'rows-debit', purchases + coalesce(fees, 0), d from s where on_card union all select statement_id, 'rows-credit', payments, c from s where on_card)
select statement_id, kind, cast(expected as bigint) expected, cast(actual as bigint) actual, expected <> actual and not (kind = 'summary' and abs(actual - expected) < 100) fault, kind = 'summary' and abs(actual - expected) between 1 and 99 rounding from x where expected is not null and actual is not null""")
def card_summary_check(spark, sf_dir):
    rows, statements = _books(spark, sf_dir)
    return reconcile.card_summary(statements.filter(F.col("kind") == "card").select("statement_id", "previous", "payments", "purchases", "fees", "due"), rows)


VERDICT = CHAIN + """, v as (select s.statement_id, coalesce(f.n, 0) n_chain, f.first first_bad_row, coalesce(b.checked, false) chain_checked, closing = opening + c - d totals_ok,
  coalesce(stated_debits, d) = d and coalesce(stated_credits, c) = c stated_ok, tautological from s
  left join (select statement_id, count(*) n, min("row") "first" from faults group by 1) f using (statement_id)
  left join (select statement_id, count(balance) > 0 checked from t group by 1) b using (statement_id))"""


@query(VERDICT + " select *, n_chain = 0 and totals_ok and stated_ok ok from v")
def verdicts(spark, sf_dir):
    return reconcile.verdicts(*_books(spark, sf_dir))


@query(VERDICT + """ select statement_id, n_chain = 0 and totals_ok and stated_ok reconciled, case when chain_checked then 'chain, totals' else 'totals' end checks,
concat_ws('; ', case when tautological then 'both endpoints are derived from the rows' end, case when not chain_checked then 'no running balance to check' end) caveats,
concat_ws('; ', case when n_chain > 0 then 'chain breaks at row ' || first_bad_row end, case when not totals_ok then 'totals differ' end, case when not stated_ok then 'stated totals differ' end) failures from v""")
def certificates(spark, sf_dir):
    out = reconcile.certificates(reconcile.verdicts(*_books(spark, sf_dir)))
    return out.select("statement_id", "reconciled", F.array_join("checks", ", ").alias("checks"), F.array_join("caveats", "; ").alias("caveats"), F.array_join("failures", "; ").alias("failures"))


@query(VERDICT + " select case when not (n_chain = 0 and totals_ok and stated_ok) then 'failed' when tautological and not chain_checked then 'weak' else 'ok' end state, count(*) n from v group by 1")
def trust_strip(spark, sf_dir):
    return report.trust_strip(reconcile.verdicts(*_books(spark, sf_dir)))


@query(VERDICT + """ select cast(t."date" as varchar) "date", t.statement_id source, t."row", t.seq, case when t.direction = 'debit' then t.amount end debit, case when t.direction = 'credit' then t.amount end credit, cast(t.balance as bigint) balance,
case when n_chain = 0 and totals_ok and stated_ok then 'yes' else 'NO' end reconciled from t join v using (statement_id)""")
def ledger_export(spark, sf_dir):
    rows, statements = _books(spark, sf_dir)
    out = export.rows(rows, reconcile.certificates(reconcile.verdicts(rows, statements)))
    return out.select(F.col("date").cast("string").alias("date"), "source", "row", "seq", *((F.col(c) * 100).cast("long").alias(c) for c in ("debit", "credit", "balance")), "reconciled")


# patterns and links


@query(REFUNDS + " select * from refunds", recursive=True)
def refunds(spark, sf_dir):
    return patterns.refunds(adapter.ledger(spark, sf_dir))


@query(DUPLICATES + " select * from duplicates", recursive=True)
def duplicates(spark, sf_dir):
    return patterns.duplicates(adapter.ledger(spark, sf_dir))


@query(RECURRING + " select * from recurring")
def recurring(spark, sf_dir):
    return patterns.recurring(adapter.ledger(spark, sf_dir))


@query(TRANSFERS + " select * from transfers", recursive=True)
def transfers(spark, sf_dir):
    return linking.transfers(adapter.exact(adapter.ledger(spark, sf_dir)))


@query(REPAYMENTS + """ select l.statement_id, l.seq, l."date", l.exact amount, r.i_id card_id, r.i_seq card_seq, r.lag_days from l left join repayments r on r.o_id = l.statement_id and r.o_seq = l.seq where direction = 'debit' and not on_card and kind = 'card bill'""", recursive=True)
def repayment_links(spark, sf_dir):
    return linking.repayment_links(adapter.exact(adapter.ledger(spark, sf_dir)))


@query(REPAYMENTS + """ select statement_id, seq, "date", exact amount from l where direction = 'credit' and on_card and seq not in (select i_seq from repayments)""", recursive=True)
def orphan_payments(spark, sf_dir):
    return linking.orphan_payments(adapter.exact(adapter.ledger(spark, sf_dir)))


SPEND = REPAYMENTS + """, f as (select coalesce(sum(exact) filter (not on_card and direction = 'debit'), 0) outflow, coalesce(sum(exact) filter (not on_card and direction = 'credit'), 0) inflow, coalesce(sum(exact) filter (on_card and direction = 'debit'), 0) card_charges,
coalesce(sum(exact) filter (not on_card and direction = 'debit' and kind = 'card bill'), 0) repaid from l), m as (select coalesce(sum(amount), 0) matched from repayments), w as (select coalesce(sum(amount), 0) moved from transfers)
select cast(outflow as bigint) outflow, cast(inflow as bigint) inflow, cast(card_charges as bigint) card_charges, cast(matched as bigint) matched, cast(repaid - matched as bigint) unmatched, cast(moved as bigint) moved,
cast(outflow - matched - moved + card_charges as bigint) true_outflow, cast(inflow - moved as bigint) true_inflow, repaid = matched complete from f, m, w"""


@query(SPEND, recursive=True)
def spend_summary(spark, sf_dir):
    return linking.spend_summary(adapter.exact(adapter.ledger(spark, sf_dir)))


@query(DUPLICATES + "," + REPAYMENTS.removeprefix(LEDGER + ",") + """ select 'duplicate' kind, statement_id, exposure amount, first_date "date" from duplicates where exposure > 0
union all select 'unmatched repayment', statement_id, exact, "date" from l where direction = 'debit' and not on_card and kind = 'card bill' and seq not in (select o_seq from repayments)
union all select 'orphan payment', statement_id, exact, "date" from l where direction = 'credit' and on_card and seq not in (select i_seq from repayments)""", recursive=True)
def open_loops(spark, sf_dir):
    rows = adapter.ledger(spark, sf_dir)
    return report.open_loops(rows, adapter.exact(rows))


# scalar functions


AMOUNTS = """r as (select o_orderkey k, cast(round(o_totalprice * 100) as bigint) c from orders)"""


def _amount_text(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    body = F.concat(F.expr("c div 100").cast("string"), F.lit("."), F.lpad((F.col("c") % 100).cast("string"), 2, "0"))
    text = F.when(F.col("k") % 5 == 0, F.concat(F.lit("₹ "), body)).when(F.col("k") % 5 == 1, F.concat(F.lit("(Rs. "), body, F.lit(")"))).when(F.col("k") % 5 == 2, F.concat(body, F.lit(" Dr"))).when(F.col("k") % 5 == 3, F.concat(F.lit("- INR "), body, F.lit(" Cr"))).otherwise(F.lit("***"))
    return o.withColumn("text", text)


@query(AMOUNTS + " select k, case k % 5 when 0 then c when 4 then null else -c end paise from r")
def amount_parse(spark, sf_dir):
    return _amount_text(spark, sf_dir).select("k", money.parse_optional_amount(F.col("text")).alias("paise"))


@query(AMOUNTS + r""" select k, case when k % 2 = 0 then '-' else '' end || '₹' || case when c < 100000 then cast(c // 100 as varchar) else
ltrim(reverse(regexp_replace(reverse(left(cast(c // 100 as varchar), -3)), '(\d\d)', '\1,', 'g')), ',') || ',' || right(cast(c // 100 as varchar), 3) end || '.' || lpad(cast(c % 100 as varchar), 2, '0') text from r""")
def amount_format(spark, sf_dir):
    return _amount_text(spark, sf_dir).select("k", money.format_paise(F.when(F.col("k") % 2 == 0, -F.col("c")).otherwise(F.col("c"))).alias("text"))


@query("r as (select o_orderkey k, o_custkey f, cast(o_orderdate as date) d from orders) select f, bool_or(day(d) > 12) or count(*) = 0 observed_day, count(*) n from r group by 1")
def date_order(spark, sf_dir):
    """The day-first evidence of every customer's dates; date_order_settled has what is made of it."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("f"), F.col("o_orderkey").alias("pos"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("date_text"))
    return o.groupBy("f").agg(*dates.order_evidence(F.col("date_text")), F.count("*").alias("n")).select("f", F.col("day_over").alias("observed_day"), "n")


@query("""r as (select o_custkey f, o_orderkey pos, cast(o_orderdate as date) t from orders), x as (select f, pos, year(t) y, case when f % 3 = 0 then month(t) else day(t) end a, case when f % 3 = 0 then day(t) else month(t) end b from r),
v as (select *, case when b <= 12 then make_date(y, b, a) end d, case when a <= 12 then make_date(y, a, b) end m from x),
w as (select *, d < last_value(d ignore nulls) over o d_back, m < last_value(m ignore nulls) over o m_back from v window o as (partition by f order by pos rows between unbounded preceding and 1 preceding)),
g as (select f, bool_or(a > 12) a_over, bool_or(b > 12) b_over, count(d) > 0 and not coalesce(bool_or(d_back), false) d_runs, count(m) > 0 and not coalesce(bool_or(m_back), false) m_runs from w group by f)
select f, case when a_over then 'day_first' when b_over or (m_runs and not d_runs) then 'month_first' else 'day_first' end date_order, a_over or b_over or d_runs <> m_runs observed, a_over and b_over inconsistent from g""")
def date_order_settled(spark, sf_dir):
    """The whole operator over the files of all customers; every third file writes the month first."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("f"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_custkey") % 3 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("date_text"))
    return dates.settle_order(o, "f", "pos", "date_text")


@query("r as (select o_orderkey k, cast(o_orderdate as date) d from orders) select k, d parsed from r")
def date_parse(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"))
    form = lambda p: F.date_format("d", p)
    text = F.when(F.col("k") % 4 == 0, form("dd/MM/yyyy")).when(F.col("k") % 4 == 1, F.upper(form("dd-MMM-yy"))).when(F.col("k") % 4 == 2, F.concat(form("d-M-yy"), F.lit("| 23:14"))).otherwise(form("yyyy-MM-dd"))
    return o.select("k", dates.parse_date(text).alias("parsed"))


NARRATIONS = """r as (select event_id, user_id u, event_id % 6 m from events), x as (select *, case m when 0 then 'UPI/DR/51' || lpad(cast(event_id as varchar), 8, '0') || '/SWIGGY LTD/swiggy.rzp@icici/payment' when 1 then 'NEFT-YESB0000001-RAMESH KUMAR-N' || lpad(cast(event_id as varchar), 9, '0')
when 2 then 'ATM WDL MG ROAD ' || u when 3 then 'ACH D-NETFLIX INDIA-' || lpad(cast(event_id as varchar), 7, '0') when 4 then 'SMS ALERT CHRG ' || u else 'IMPS/P2A/9' || lpad(cast(u as varchar), 9, '0') || '@paytm/house rent' end raw from r)"""


def _narrations(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("u"), (F.col("event_id") % 6).alias("m"))
    number = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    forms = [("UPI/DR/51", number("event_id", 8), "/SWIGGY LTD/swiggy.rzp@icici/payment"), ("NEFT-YESB0000001-RAMESH KUMAR-N", number("event_id", 9), ""), ("ATM WDL MG ROAD ", F.col("u").cast("string"), ""), ("ACH D-NETFLIX INDIA-", number("event_id", 7), ""), ("SMS ALERT CHRG ", F.col("u").cast("string"), "")]
    raw = F
    for k, (a, b, c) in enumerate(forms):
        raw = raw.when(F.col("m") == k, F.concat(F.lit(a), b, F.lit(c)))
    return e.withColumn("raw", raw.otherwise(F.concat(F.lit("IMPS/P2A/9"), number("u", 9), F.lit("@paytm/house rent"))))


@query(NARRATIONS + " select event_id, case m when 0 then 'upi' when 1 then 'neft' when 2 then 'atm' when 3 then 'ach' when 4 then 'charges' else 'imps' end channel from x")
def channel_detect(spark, sf_dir):
    return _narrations(spark, sf_dir).select("event_id", narration.detect_channel(F.col("raw")).alias("channel"))


@query(NARRATIONS + """ select event_id, case m when 0 then 'SWIGGY LTD' when 1 then 'RAMESH KUMAR' when 2 then raw when 3 then 'NETFLIX INDIA' when 4 then raw else 'house rent' end counterparty,
case m when 0 then 'swiggy.rzp@icici' when 5 then '9' || lpad(cast(u as varchar), 9, '0') || '@paytm' end vpa, case m when 0 then '51' || lpad(cast(event_id as varchar), 8, '0') when 1 then 'N' || lpad(cast(event_id as varchar), 9, '0') when 3 then lpad(cast(event_id as varchar), 7, '0') end reference from x""")
def narration_parts(spark, sf_dir):
    out = _narrations(spark, sf_dir).select("event_id", narration.parse_narration(F.col("raw")).alias("p"))
    return out.select("event_id", "p.counterparty", "p.vpa", "p.reference")


@query(NARRATIONS + """ select event_id, case m when 0 then 'Swiggy' when 1 then 'Ramesh Kumar' when 2 then 'Atm Wdl Mg Road ' || u when 3 then 'Netflix' when 4 then 'Sms Alert Chrg ' || u else 'House Rent' end "name",
case m when 0 then 'food' when 1 then 'transfer' when 2 then 'cash' when 3 then 'entertainment' when 4 then 'fees' else 'rent' end category, case m when 0 then 'merchant' when 1 then 'person' when 2 then 'cash' when 3 then 'merchant' when 4 then 'bank' else 'person' end kind,
case m when 0 then 'prefix' when 3 then 'lexicon' else 'segmented' end source from x""")
def merchant_identify(spark, sf_dir):
    out = _narrations(spark, sf_dir).select("event_id", merchants.identify(F.col("raw")).alias("p"))
    return out.select("event_id", "p.name", "p.category", "p.kind", "p.source")


@query("r as (select p_partkey k, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) s from part) select * from r")
def slug_lookup(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), merchants.slug(F.col("p_name")).alias("s"))


@query("""r as (select unnest(string_split(p_name, ' ')) w from part), k as (select unnest(string_split(p_type, ' ')) w from part) select distinct lower(w) w from r where lower(w) not in (select lower(w) from k)""")
def unknown_names_anti(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    words = lambda c: p.select(F.explode(F.split(F.lower(c), " ")).alias("w")).distinct()
    return words("p_name").join(words("p_type"), "w", "left_anti")


@query("""q as (select user_id client, cast(floor(epoch(ts::timestamp)) as bigint) "at", event_id seq from events),
o as (select *, row_number() over (partition by client order by "at", seq) rn from q),
step as (select client, cast(0 as bigint) rn, cast(null as bigint) "at", cast(null as bigint) seq, false admitted, cast([] as bigint[]) hits from (select distinct client from q)
  union all
  select s.client, o.rn, o."at", o.seq, len(w.live) < 3, case when len(w.live) < 3 then list_append(w.live, o."at") else w.live end
  from step s join o on o.client = s.client and o.rn = s.rn + 1, lateral (select list_filter(s.hits, lambda h: h > o."at" - 86400) live) w)
select client, "at", seq, admitted from step where rn > 0""", recursive=True)
def request_budget(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("client"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    return budget.admitted(e, seconds=86_400, allowance=3)


@query("""q as (select user_id client, cast(floor(epoch(ts::timestamp)) as bigint) "at", event_id seq, event_type <> 'error' reachable, cast(json_extract_string(props, '$.k') as bigint) % 3 <> 0 good from events),
o as (select *, row_number() over (partition by client order by "at", seq) rn from q),
step as (select client, cast(0 as bigint) rn, cast(null as bigint) "at", cast(null as bigint) seq, cast(null as varchar) source, false good, cast(null as bigint) since, false was from (select distinct client from q)
  union all
  select s.client, o.rn, o."at", o.seq, w.source, case w.source when 'asked' then o.good when 'unreachable' then false else s.was end, case when w.source = 'asked' then o."at" else s.since end, case when w.source = 'asked' then o.good else s.was end
  from step s join o on o.client = s.client and o.rn = s.rn + 1, lateral (select case when o."at" - s.since < 43200 then 'remembered' when o.reachable then 'asked' when s.was and o."at" - s.since < 259200 then 'grace' else 'unreachable' end source) w)
select client, "at", seq, source, good from step where rn > 0""", recursive=True)
def remembered_verdicts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    lookups = e.select(F.col("user_id").alias("client"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("reachable"), (k % 3 != 0).alias("good"))
    return budget.remembered(lookups, fresh=43_200, grace=259_200)


@query(BOOKS + """, p as (select statement_id, count(*) k, string_agg('{"seq":' || seq || ',"date":"' || cast("date" as varchar) || '","direction":"' || direction || '","amount":' || amount || ',"balance":' || coalesce(cast(balance as varchar), 'null') || '}', ',' order by seq) j from t group by 1),
f as (select statement_id, string_agg('{"seq":' || seq || ',"row":' || "row" || ',"expected":' || expected || ',"actual":' || actual || ',"delta":' || delta || '}', ',' order by seq) j from (""" + ORACLE["chain_faults"] + """) group by 1),
d as (select statement_id, string_agg('{"name":"' || "name" || '","amount":' || amount || ',"n":' || n || ',"exposure":' || exposure || '}', ',' order by "name", amount, n, exposure) j from (""" + ORACLE["duplicates"] + """) group by 1),
c as (select statement_id, string_agg('{"name":"' || "name" || '","typical":' || typical || ',"annualised":' || annualised || '}', ',' order by "name", typical, annualised) j from (""" + ORACLE["recurring"] + """) group by 1)
select s.statement_id, '{"statement_id":"' || s.statement_id || '","totals":{"opening":' || s.opening || ',"closing":' || cast(s.closing as bigint) || '},"transactions":[' || coalesce(p.j, '') || '],"discrepancies":[' || coalesce(f.j, '') || '],"doubled":[' || coalesce(d.j, '') || '],"recurring":[' || coalesce(c.j, '') || ']}' payload
from s left join p using (statement_id) left join f using (statement_id) left join d using (statement_id) left join c using (statement_id)""", recursive=True)
def statement_payloads(spark, sf_dir):
    """One JSON document for each statement, from five tables that are grouped once."""
    ledger = adapter.ledger(spark, sf_dir)
    rows, books = adapter.transactions(ledger), adapter.statements(ledger)
    return payload.payloads(
        {"totals": books.select("statement_id", "opening", "closing")},
        {
            "transactions": (rows.select("statement_id", "seq", "date", "direction", "amount", "balance"), ["seq"]),
            "discrepancies": (reconcile.chain_faults(rows, books), ["seq"]),
            "doubled": (patterns.duplicates(ledger).select("statement_id", "name", "amount", "n", "exposure"), ["name", "amount", "n", "exposure"]),
            "recurring": (patterns.recurring(ledger).select("statement_id", "name", "typical", "annualised"), ["name", "typical", "annualised"]),
        },
    )


# statement files


def _money(c: str) -> Column:
    return F.concat(F.expr(f"{c} div 100").cast("string"), F.lit("."), F.lpad((F.col(c) % 100).cast("string"), 2, "0"))


def _grid(top: DataFrame, rows: DataFrame) -> DataFrame:
    """top(statement_id, lines array<array<string>>) above rows(statement_id, seq, cells), numbered from 1."""
    above = top.select("statement_id", F.posexplode("lines").alias("at", "cells")).select("statement_id", (F.col("at") + 1).cast("int").alias("number"), "cells")
    order = Window.partitionBy("statement_id").orderBy("seq")
    below = rows.withColumn("at", F.row_number().over(order)).join(top.select("statement_id", F.size("lines").alias("n")), "statement_id")
    return above.unionByName(below.select("statement_id", (F.col("at") + F.col("n")).cast("int").alias("number"), "cells"))


def _line(*cells) -> Column:
    return F.array(*(F.lit(c) if isinstance(c, str) else c for c in cells))


def _bank_grid(spark, sf_dir) -> DataFrame:
    """Every account that isn't a card as a bank's file: a heading, an account number, and rows with a running balance."""
    rows = adapter.exact(adapter.ledger(spark, sf_dir)).filter("not on_card")
    order = Window.partitionBy("statement_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("balance", adapter.OPENING + 10**12 + F.sum(money.signed(F.col("direction"), F.col("amount"))).over(order))
    side = lambda d: F.when(F.col("direction") == d, _money("amount")).otherwise("")
    cells = _line(F.date_format("date", "dd-MMM-yyyy"), F.concat(F.lit("UPI/"), F.col("name"), F.lit("/x@icici")), side("debit"), side("credit"), _money("balance"))
    top = rows.groupBy("statement_id").agg(F.min("pos").alias("pos"))
    lines = F.array(_line("HDFC Bank statement"), _line("Account No: ", F.concat(F.lit("Account No: 900"), F.lpad(F.col("pos").cast("string"), 9, "0"))), _line("Date", "Narration", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance"))
    return _grid(top.select("statement_id", lines.alias("lines")), rows.select("statement_id", "seq", cells.alias("cells")))


@query(LEDGER + """ select statement_id, 'HDFC' bank, 'XXXXXXXX' || right(lpad(cast(pos as varchar), 9, '0'), 4) account_hint, cast(1000000100000 as bigint) opening,
  cast(1000000100000 + sum(case when direction = 'credit' then exact else -exact end) as bigint) closing, count(*) n, cast(sum(exact) filter (direction = 'debit') as bigint) debits, cast(sum(exact) filter (direction = 'credit') as bigint) credits,
  arg_min("date", seq) period_start, arg_max("date", seq) period_end, true ok from l where not on_card group by statement_id, pos""")
def bank_files(spark, sf_dir):
    """Grids to statements and rows, proved."""
    found = load.from_grid(shuffled(_bank_grid(spark, sf_dir), "grid"))
    rows = shuffled(found.transactions, "transactions")
    of = lambda d: F.sum(F.when(F.col("direction") == d, F.col("amount"))).alias(f"{d}s")
    moved = rows.groupBy("statement_id").agg(F.count("*").alias("n"), of("debit"), of("credit"))
    verdict = reconcile.verdicts(rows, found.banks).select("statement_id", "ok")
    return found.banks.join(moved, "statement_id").join(verdict, "statement_id").select("statement_id", "bank", "account_hint", "opening", "closing", "n", "debits", "credits", "period_start", "period_end", "ok")


def _card_grid(spark, sf_dir) -> DataFrame:
    """Every card account as an issuer's file: a summary box with figures beside labels or below them, then rows, payments marked Cr."""
    ledger = adapter.ledger(spark, sf_dir)
    rows, books = adapter.exact(ledger).filter("on_card"), adapter.statements(ledger).filter("kind = 'card'")
    cells = _line(F.date_format("date", "dd-MMM-yyyy"), F.concat(F.lit("POS "), F.col("name")), F.concat(_money("amount"), F.when(F.col("direction") == "credit", " Cr").otherwise("")))
    stated = F.coalesce("purchases", F.lit(0))
    books = books.withColumns({"owed": F.col("due") + 10**10, "before": F.col("previous") + 10**10, "bought": stated})
    box = F.array(
        _line("ICICI credit card"), _line("Payment Due Date", "15-Feb-2024"), _line("Total Dues", "", _money("owed")), _line("Previous Balance", "Payments / Credits"), _line(_money("before"), _money("payments")),
        F.when(F.col("purchases").isNotNull(), _line("Purchases / Debits", _money("bought"))).otherwise(_line("")), F.when(F.col("fees").isNotNull(), _line("Finance Charges", _money("fees"))).otherwise(_line("")), _line("Date", "Transaction Details", "Amount (INR)"),
    )
    return _grid(books.select("statement_id", box.alias("lines")), rows.select("statement_id", "seq", cells.alias("cells")))


@query(BOOKS + """ select statement_id, 'ICICI' issuer, 10000000000 + due total_due, 10000000000 + previous previous_balance, payments, cast(purchases as bigint) purchases, cast(fees as bigint) fees, date '2024-02-15' due_date, n, cast(d as bigint) debits, cast(c as bigint) credits,
  concat_ws(', ', 'rows-credit', case when purchases is not null then 'rows-debit' end, case when purchases is not null then 'summary' end) checks,
  payments = c and (purchases is null or (purchases + coalesce(fees, 0) = d and abs(due - (previous - payments + purchases + coalesce(fees, 0))) < 100)) reconciled
from s join (select statement_id, count(*) n from l group by 1) using (statement_id) where on_card""")
def card_files(spark, sf_dir):
    """Grids to card statements, their summary boxes and rows, proved."""
    found = load.from_grid(shuffled(_card_grid(spark, sf_dir), "grid"))
    rows, statements = shuffled(found.transactions, "transactions"), shuffled(found.cards, "cards")
    of = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0)).alias(f"{d}s")
    moved = rows.groupBy("statement_id").agg(F.count("*").alias("n"), of("debit"), of("credit"))
    summaries = statements.select("statement_id", F.col("previous_balance").alias("previous"), "payments", "purchases", "fees", F.col("total_due").alias("due"))
    verdict = reconcile.card_verdicts(summaries, rows).select("statement_id", F.array_join("checks", ", ").alias("checks"), "reconciled")
    return statements.join(moved, "statement_id").join(verdict, "statement_id").select("statement_id", "issuer", "total_due", "previous_balance", "payments", "purchases", "fees", "due_date", "n", "debits", "credits", "checks", "reconciled")


WELDS = (("SWIGGYINSTAMART", "Swiggy Instamart", "groceries"), ("MYNTRADESIGNS", "Myntra", "shopping"), ("FRESHDAIRYMILK", "Fresh Dairy Milk", "uncategorised"), ("QWXZPLKJHGFD", "Qwxzplkjhgfd", "uncategorised"), ("RameshKumar", "Ramesh Kumar", "uncategorised"), ("BLUEMOONTRADERS", "Blue Moon Traders", "uncategorised"))


@query("e as (select event_id seq, user_id u, event_id % 6 m from events) select 'acct-' || u statement_id, seq, case m " + " ".join(f"when {k} then '{name}'" for k, (_, name, _) in enumerate(WELDS)) + """ end "name", case m """ + " ".join(f"when {k} then '{category}'" for k, (_, _, category) in enumerate(WELDS)) + " end category from e")
def labelled_ledger(spark, sf_dir):
    """Welded names cut by known words and by those that a statement itself writes with spaces (blue moon traders), then labelled."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("acct-"), F.col("user_id").cast("string")).alias("statement_id"), F.col("event_id").alias("seq"), (F.col("event_id") % len(WELDS)).alias("m"))
    name = F
    for k, (weld, *_) in enumerate(WELDS):
        name = name.when(F.col("m") == k, weld)
    spoken = F.when(F.col("m") == 5, "blue moon traders").when(F.col("m") == 3, "fresh dairy milk").otherwise("paid")
    rows = e.select("statement_id", "seq", F.concat(F.lit("UPI/"), name.otherwise(None), F.lit("/"), F.concat(F.lit("x"), F.col("seq").cast("string")), F.lit("@icici/"), spoken).alias("narration"))
    return labels.labelled(rows).select("statement_id", "seq", "name", "category")


QUESTIONS = ("How much did I spend on c1 in January 2024?", "how many times did I pay m3", "what was my biggest expense in c2?", "How much income did I receive from m1 in 2024?", "how much did I spend at Tesco", "tell me a joke")


@query(LEDGER + """, q as (select 0 k, 'total' intent, cast(sum(amount) as bigint) amount, count(*) n, '' refused from l where category = 'c1' and direction = 'debit' and "date" between '2024-01-01' and '2024-01-31'
union all select 1, 'count', cast(coalesce(sum(amount), 0) as bigint), count(*), '' from l where "name" = 'm3' and direction = 'debit'
union all select 2, 'top', cast(max(a) as bigint), least(count(*), 5), '' from (select sum(amount) a from l where category = 'c2' and direction = 'debit' group by "name")
union all select 3, 'total', cast(sum(amount) as bigint), count(*), '' from l where "name" = 'm1' and direction = 'credit' and year("date") = 2024
union all select 4, 'total', null, 0, 'tesco' union all select 5, null, null, 0, '') select * from q""")
def ask_questions(spark, sf_dir):
    """English questions over the ledger; unknown names are refused, other texts aren't taken."""
    rows = written(adapter.ledger(spark, sf_dir), "ledger")
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "k int, text string")
    return question.answered(asked, rows).select("k", "intent", "amount", "n", F.array_join("refused", ", ").alias("refused"))


ASKED = """, q as (select 0 g, c.category x, cast(sum(amount) as bigint) amount, count(amount) n, '' refused, 'total' intent from (select 'c' || range category from range(3)) c
    left join l on l.category = c.category and direction = 'debit' and "date" between '2024-01-01' and '2024-01-31' group by c.category
  union all select 1, c."name", cast(coalesce(sum(amount), 0) as bigint), count(amount), '', 'count' from (select 'm' || range "name" from range(8)) c left join l on l."name" = c."name" and direction = 'debit' group by c."name"
  union all select 2, category, cast(max(a) as bigint), least(count(*), 5), '', 'top' from (select category, "name", sum(amount) a from l where direction = 'debit' group by all) group by category
  union all select 3, c."name", cast(sum(amount) as bigint), count(amount), '', 'total' from (select 'm' || range "name" from range(8)) c left join l on l."name" = c."name" and direction = 'credit' and year("date") = 2024 group by c."name"),
w as (select seq, seq % 6 g, case seq % 6 when 0 then 'c' || (seq % 3) when 1 then 'm' || (seq % 8) when 2 then 'c' || (seq % 3) when 3 then 'm' || (seq % 8) end x from l)"""


def _asked(spark, sf_dir) -> DataFrame:
    """(seq, text): a question for each event: of a category in a month, of a merchant, of a largest spend, of income, of a shop that no ledger knows, and none at all."""
    seq = F.col("event_id")
    kind, shop, sort = seq % 6, F.concat(F.lit("m"), (seq % 8).cast("string")), F.concat(F.lit("c"), (seq % 3).cast("string"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    text = (
        F.when(kind == 0, say("How much did I spend on ", sort, " in January 2024?"))
        .when(kind == 1, say("how many times did I pay ", shop))
        .when(kind == 2, say("What was my biggest expense in ", sort, "?"))
        .when(kind == 3, say("How much income did I receive from ", shop, " in 2024?"))
        .when(kind == 4, say("how much did I spend at Tesco", seq.cast("string")))
        .otherwise(say("tell me joke ", seq.cast("string")))
    )
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(seq.alias("seq"), text.alias("text"))


@query(LEDGER + ASKED + """ select w.seq, case w.g when 4 then 'total' when 5 then null else q.intent end intent, w.g <> 5 understood, case w.g when 4 then 'tesco' || w.seq else '' end refused, q.amount, coalesce(q.n, 0) n
  from w left join q on w.g = q.g and w.x = q.x""")
def questions_table(spark, sf_dir):
    """Thousands of questions in one plan: each distinct text is read once, each distinct query computed once."""
    rows = written(adapter.ledger(spark, sf_dir), "ledger")
    return question.answered(_asked(spark, sf_dir), rows).select("seq", "intent", "understood", F.array_join("refused", ", ").alias("refused"), "amount", "n")


@query(LEDGER + """, a as (select seq, seq % 7 g, 'c' || (seq % 3) category, 'm' || (seq % 8) "name" from l),
t as (select category, cast(sum(amount) as bigint) amount, count(*) n from l where direction = 'debit' and on_card group by category),
c as (select "name", cast(sum(amount) as bigint) amount, count(*) n from l where direction = 'credit' and "date" between '2024-01-05' and '2024-01-20' group by "name")
select a.seq, case g when 0 then 'total' when 1 then 'count' when 6 then 'duplicates' end intent, case when g = 1 then a."name" end merchant, case when g = 0 then a.category end category,
  case g when 0 then 'debit' when 1 then 'credit' end direction, case g when 0 then t.amount when 1 then coalesce(c.amount, 0) end amount, case g when 0 then coalesce(t.n, 0) when 1 then coalesce(c.n, 0) end n,
  case g when 2 then 'merchant: nothing is called shop' || a.seq || ' here' when 3 then 'direction: not a direction: sideways; period: the period ends before it starts' when 4 then 'answer: not a JSON object' when 5 then 'intent: unsure about ' || a.seq end reasons
from a left join t on g = 0 and t.category = a.category left join c on g = 1 and c."name" = a."name" """)
def model_answers(spark, sf_dir):
    """A model's answers as JSON, one for each event: those that are queries with their figures, the others with all their faults."""
    rows = written(adapter.ledger(spark, sf_dir), "ledger")
    seq = F.col("event_id")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    kind, shop, sort = seq % 7, F.concat(F.lit("m"), (seq % 8).cast("string")), F.concat(F.lit("c"), (seq % 3).cast("string"))
    text = (
        F.when(kind == 0, say('{"intent": "TOTAL", "category": "', sort, '", "on_card": true, "merchant": null}'))
        .when(kind == 1, say('Here:\n```json\n{"intent": "count", "merchant": " ', shop, ' ", "direction": "In", "on_card": true, "period": {"start": "2024-01-05", "end": "2024-01-20"}}\n```'))
        .when(kind == 2, say('{"intent": "total", "merchant": "shop', seq.cast("string"), '"}'))
        .when(kind == 3, say('{"intent": "total", "direction": "sideways", "period": {"start": "2024-02-01", "end": "2024-01-01"}}'))
        .when(kind == 4, say("I can't say, {", seq.cast("string"), ")"))
        .when(kind == 5, say('{"intent": null, "reason": "unsure about ', seq.cast("string"), '"}'))
        .otherwise(say('{"intent": "duplicates", "category": "', sort, '", "direction": "out"}'))
    )
    answers = spark.read.parquet(f"{sf_dir}/events.parquet").select(seq.alias("answer_id"), text.alias("text"))
    good, rejects = question.model_queries(answers, rows)
    figured = question.with_figures(good, rows).withColumn("counted", F.col("intent") != "duplicates")
    faults = rejects.groupBy("answer_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("field", F.lit(": "), "reason"))), "; ").alias("reasons"))
    columns = ["intent", "merchant", "category", "direction", *(F.when(F.col("counted"), F.col(c)).alias(c) for c in ("amount", "n"))]
    return figured.select(F.col("answer_id").alias("seq"), *columns).unionByName(faults.withColumnRenamed("answer_id", "seq"), allowMissingColumns=True)


@query(LEDGER + ASKED + """, texts as (select distinct case g when 0 then 'How much did I spend on ' || x || ' in January 2024?' when 1 then 'how many times did I pay ' || x when 2 then 'What was my biggest expense in ' || x || '?' when 3 then 'How much income did I receive from ' || x || ' in 2024?' when 4 then 'how much did I spend at Tesco' || seq else 'tell me joke ' || seq end "text", g, x from w),
r as (select r.range r, t.*, q.amount,
    case when cast('0x' || substr(sha256(lower(t."text")), 1, 8) as bigint) % 100 < 40 then 'test' else 'dev' end split, case when t.g < 3 then 'spending' when t.g = 3 then 'income' else 'refusal' end kind,
    r.range = 0 or t.g not in (0, 3) query_ok,
    r.range = 0 or t.g not in (0, 3) or (t.g = 0 and q.amount is not distinct from e.amount) or (t.g = 3 and q.amount is not distinct from d.amount) answer_ok, t.g > 3 refused, length(t."text") + 10 * r.range ms
  from texts t, range(2) r left join q on t.g = q.g and t.x = q.x
  left join (select category, cast(sum(amount) as bigint) amount from l where direction = 'debit' group by category) e on t.g = 0 and e.category = t.x
  left join (select "name", cast(sum(amount) as bigint) amount from l where direction = 'debit' and year("date") = 2024 group by "name") d on t.g = 3 and d."name" = t.x)
select case r when 0 then 'reader' else 'careless' end reader, kind, split, count(*) n, count(*) filter (query_ok) queries_ok, count(*) filter (answer_ok) answers_ok, count(*) filter (refused) refused, cast(median(ms) as double) p50_latency_ms
from r group by cube(r, kind, split) having r is not null""")
def evaluation_cards(spark, sf_dir):
    """The reader of questions, and one that overlooks periods and income, scored on the distinct questions of questions_table by kind and split; the right queries are built from what each question was made of."""
    rows = written(adapter.ledger(spark, sf_dir), "ledger")
    texts = written(_asked(spark, sf_dir).select("text", (F.col("seq") % 6).alias("g")).distinct(), "asked")
    found = written(question.answered(texts, rows), "read")
    refused = F.size("refused") > 0
    fields = [F.when(~refused, F.col(c)).alias(c) for c in question.QUERY]
    taken = found.select("text", *fields, F.length("text").cast("double").alias("latency_ms"), F.lit(0.0).alias("cost"))
    # only questions of income keep their year, so that the direction alone is misread there
    income = lambda c: F.when(F.col("direction") == "credit", F.col(c))
    careless = taken.withColumns({"start": income("start"), "end": income("end"), "direction": F.when(F.col("intent").isNotNull(), "debit"), "latency_ms": F.col("latency_ms") + 10})
    attempts = taken.withColumn("reader", F.lit("reader")).unionByName(careless.withColumn("reader", F.lit("careless")))
    word = lambda k: F.regexp_extract("text", k, 1)
    g = F.col("g")
    intent = F.when(g.isin(0, 3), "total").when(g == 1, "count").when(g == 2, "top")
    day = lambda m, d: F.when(g == 0, F.lit(date(2024, 1, d))).when(g == 3, F.lit(date(2024, m, 31 if m == 12 else 1)))
    gold = texts.select("text", F.when(g < 3, "spending").when(g == 3, "income").otherwise("refusal").alias("kind"), intent.alias("intent"), F.when(g.isin(1, 3), word(r"\b(m\d+)\b")).alias("merchant"), F.when(g.isin(0, 2), word(r"\b(c\d+)\b")).alias("category"), day(1, 1).alias("start"), day(12, 31).alias("end"), F.when(g == 3, "credit").when(g < 3, "debit").alias("direction"), F.lit(None).cast("boolean").alias("on_card"))
    cards = evaluation.scorecards(written(evaluation.judged(attempts, gold, rows), "judged"))
    return cards.drop("cost")


#: Where the printed columns start, in points, and how many rows a page has.
PRINTED, PAGE_ROWS = (("Date", 10), ("Narration", 110), ("Withdrawal Amt.", 330), ("Deposit Amt.", 430), ("Closing Balance", 560)), 40


def _printed(grid: DataFrame) -> DataFrame:
    """The bank grids as words on pages of PAGE_ROWS rows, with the header on each."""
    rows = grid.filter("number > 3").select("statement_id", (F.col("number") - 4).alias("k"), "cells")
    placed = rows.select("statement_id", F.expr(f"k div {PAGE_ROWS} + 1").cast("int").alias("page"), (50.0 + 11 * (F.col("k") % PAGE_ROWS + 1)).alias("top"), F.posexplode("cells").alias("at", "text")).filter("text <> ''")
    x0 = F.get(F.array(*(F.lit(float(x)) for _, x in PRINTED)), "at")
    placed = placed.select("statement_id", "page", "top", x0.alias("x0"), (x0 + 4 * F.length("text")).alias("x1"), "text")
    heads, line = [], [(20.0, 10.0, "HDFC"), (20.0, 28.0, "Bank")]
    for name, x in PRINTED:
        for w in name.split():
            heads.append((50.0, float(x), w))
            x += 4 * len(w) + 2
    word = lambda items: F.array(*(F.struct(F.lit(top).alias("top"), F.lit(x).alias("x0"), F.lit(x + 4.0 * len(w)).alias("x1"), F.lit(w).alias("text")) for top, x, w in items))
    pages = placed.select("statement_id", "page").distinct().select("statement_id", "page", F.inline(F.when(F.col("page") == 1, word(line + heads)).otherwise(word(heads))))
    return placed.unionByName(pages)


@query(LEDGER + """ select statement_id, 'HDFC' bank, cast(1000000100000 as bigint) opening, cast(1000000100000 + sum(case when direction = 'credit' then exact else -exact end) as bigint) closing, count(*) n,
  cast(sum(exact) filter (direction = 'debit') as bigint) debits, cast(sum(exact) filter (direction = 'credit') as bigint) credits, true ok from l where not on_card group by statement_id""")
def printed_statements(spark, sf_dir):
    """Words with their places to statements and rows, proved."""
    found = load.from_grid(shuffled(words.grid(_printed(_bank_grid(spark, sf_dir))), "grid"))
    rows = shuffled(found.transactions, "transactions")
    of = lambda d: F.sum(F.when(F.col("direction") == d, F.col("amount"))).alias(f"{d}s")
    moved = rows.groupBy("statement_id").agg(F.count("*").alias("n"), of("debit"), of("credit"))
    verdict = reconcile.verdicts(rows, found.banks).select("statement_id", "ok")
    return found.banks.join(moved, "statement_id").join(verdict, "statement_id").select("statement_id", "bank", "opening", "closing", "n", "debits", "credits", "ok")


#: Rows of a page's grid, their height, and where the columns of the two other layouts begin; a spaced column's right edge.
DRAWN, SPACED = (10.0, 100.0, 320.0, 420.0, 550.0, 680.0), ((10.0, None), (110.0, None), (330.0, 372.0), (430.0, 468.0))


def _laid_out(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, words, rules): the bank grids by their account numbers in drawn tables, printed under headings, and spaced out with headings that fall apart; cards as letters without a table, and as pages without text."""
    cut = F.substring("statement_id", 6, 20).cast("long")
    grid = shuffled(_bank_grid(spark, sf_dir).withColumn("layout", cut % 3), "grid")
    rows = grid.filter("number > 3").select("statement_id", "layout", (F.col("number") - 4).alias("k"), "cells")
    at = lambda h: (50 + h * (F.col("k") % PAGE_ROWS + 1)).cast("double").alias("top")
    page = F.expr(f"k div {PAGE_ROWS} + 1").cast("int").alias("page")
    word = "struct<top:double,x0:double,x1:double,text:string>"
    texts = lambda items: F.array(*(F.struct(F.lit(float(t)).alias("top"), F.lit(float(x)).alias("x0"), F.lit(x + 4.0 * len(w)).alias("x1"), F.lit(w).alias("text")) for t, x, w in items)).cast(f"array<{word}>")

    # drawn: a row is 18 high, its text 5 below the rule
    drawn = rows.filter("layout = 0").select("statement_id", page, at(18), F.posexplode("cells").alias("c", "text")).filter("text <> ''")
    left = F.get(F.array(*(F.lit(x + 3) for x in DRAWN)), "c")
    drawn = drawn.select("statement_id", "page", (F.col("top") + 5).alias("top"), left.alias("x0"), (left + 4 * F.length("text")).alias("x1"), "text")
    sheets = rows.filter("layout = 0").groupBy("statement_id", page).agg(F.max(at(18)).alias("last"))
    heads = []
    for (name, _), x in zip(PRINTED, DRAWN, strict=False):
        x += 3
        for w in name.split():
            heads.append((55, x, w))
            x += 4 * len(w) + 2
    line = [(20, 10, "HDFC"), (20, 28, "Bank")]
    drawn = drawn.unionByName(sheets.select("statement_id", "page", F.inline(F.when(F.col("page") == 1, texts(line + heads)).otherwise(texts(heads)))))
    rule = lambda *p: F.struct(*(F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), p, strict=True)))
    foot = F.col("last") + 18
    upright = F.array(*(rule(x, 50.0, x, foot) for x in DRAWN))
    flat = F.transform(F.sequence(F.lit(0), ((foot - 50) / 18).cast("int")), lambda k: rule(DRAWN[0], (50 + 18 * k).cast("double"), DRAWN[-1], (50 + 18 * k).cast("double")))
    rules = sheets.select("statement_id", "page", F.inline(F.concat(upright, flat)))

    # spaced: figures stand at the right edges of their columns, and the balance only in the first and last lines
    spaced = rows.filter("layout = 2").select("statement_id", page, at(11), F.posexplode(F.slice("cells", 1, 4)).alias("c", "text")).filter("text <> ''")
    right = F.get(F.array(*(F.lit(r) for _, r in SPACED)), "c")
    x0 = F.coalesce(right - 4 * F.length("text"), F.get(F.array(*(F.lit(x) for x, _ in SPACED)), "c"))
    spaced = spaced.select("statement_id", "page", "top", x0.alias("x0"), (x0 + 4 * F.length("text")).alias("x1"), "text")
    ends = rows.filter("layout = 2").groupBy("statement_id").agg(F.max("k").alias("k"), F.max_by(F.get("cells", 4), "k").alias("closing"))
    names = [(40, 10, "Date"), (40, 110, "Narration"), (40, 330, "Paid"), (40, 360, "Out"), (40, 430, "Paid"), (40, 460, "In")]
    first = ends.select("statement_id", F.lit(1).alias("page"), F.inline(texts(line + names + [(50, 110, "Opening"), (50, 140, "Balance"), (50, 430, f"{(adapter.OPENING + 10**12) / 100:.2f}")])))
    last = F.concat(texts([(0, 110, "Closing"), (0, 140, "Balance")]), F.array(F.struct(F.lit(0.0).alias("top"), F.lit(430.0).alias("x0"), (430.0 + 4 * F.length("closing")).alias("x1"), F.col("closing").alias("text"))).cast(f"array<{word}>"))
    last = ends.withColumn("k", F.col("k") + 1).select("statement_id", page, at(11).alias("y"), F.inline(last)).select("statement_id", "page", F.col("y").alias("top"), "x0", "x1", "text")
    spaced = spaced.unionByName(first).unionByName(last)

    cards = adapter.statements(adapter.ledger(spark, sf_dir)).filter("kind = 'card'").select("statement_id", cut.alias("pos"))
    letter = cards.filter("pos % 8 = 0").select("statement_id", F.lit(1).alias("page"), F.inline(texts([(72, 72, "Dear"), (72, 94, "customer,"), (72, 136, "no"), (72, 150, "statement")])))
    headed = _printed(grid.filter("layout = 1").drop("layout"))
    files = grid.select("statement_id").distinct().unionByName(cards.select("statement_id"))
    return files, headed.unionByName(drawn).unionByName(spaced).unionByName(letter), rules


@query(LEDGER + f""" select statement_id, ['ruled', 'headings', 'spaces'][pos % 3 + 1] how, cast(null as varchar) reason, cast(1000000100000 as bigint) opening, cast(1000000100000 + sum(case when direction = 'credit' then exact else -exact end) as bigint) closing, count(*) n,
  cast(sum(exact) filter (direction = 'debit') as bigint) debits, cast(sum(exact) filter (direction = 'credit') as bigint) credits, true ok from l where not on_card group by statement_id, pos
union all select distinct statement_id, null, case when pos % 8 = 0 then '{tables.NO_TABLE}' else '{tables.NO_TEXT}' end, null, null, null, null, null, null from l where on_card""")
def recovered_tables(spark, sf_dir):
    """Drawn, headed and spaced tables to statements and rows, proved; what has none is refused with a reason."""
    grid, rejects = tables.recovered(*_laid_out(spark, sf_dir))
    grid = shuffled(grid, "recovered")
    found = load.from_grid(grid.drop("how"), rejects)
    rows = shuffled(found.transactions, "transactions")
    of = lambda d: F.sum(F.when(F.col("direction") == d, F.col("amount"))).alias(f"{d}s")
    moved = rows.groupBy("statement_id").agg(F.count("*").alias("n"), of("debit"), of("credit"))
    verdict = reconcile.verdicts(rows, found.banks).select("statement_id", "ok")
    good = found.banks.join(moved, "statement_id").join(verdict, "statement_id").join(grid.select("statement_id", "how").distinct().hint("merge"), "statement_id")
    columns = ["statement_id", "how", F.lit(None).cast("string").alias("reason"), "opening", "closing", "n", "debits", "credits", "ok"]
    return good.select(*columns).unionByName(found.rejects, allowMissingColumns=True)
