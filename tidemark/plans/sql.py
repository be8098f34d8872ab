"""DuckDB SQL that checks the queries, from common pieces."""

from __future__ import annotations

_W63 = "(PARTITION BY ticker ORDER BY ts ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"


def _px(name: str, ticker: str, table: str, ts: str, price: str) -> str:
    return (
        f"{name}_d AS (SELECT CAST({ts} AS DATE) AS ts, {ticker} AS ticker, avg({price}) AS p FROM {table} GROUP BY 1,2), "
        f"{name}_g AS (SELECT t.ts, k.ticker, d.p FROM (SELECT DISTINCT ts FROM {name}_d) t CROSS JOIN (SELECT DISTINCT ticker FROM {name}_d) k LEFT JOIN {name}_d d ON d.ts=t.ts AND d.ticker=k.ticker), "
        f"{name} AS (SELECT ticker, ts, CASE WHEN count(p) OVER {_W63} >= 10 THEN round(avg(p) OVER {_W63}, 6) END AS close FROM {name}_g) "
    )


_PX = _px("px", "l_returnflag", "lineitem", "l_shipdate", "l_extendedprice")
PX = f"WITH {_PX}"
PAIRS = ", s AS (SELECT a.ticker || '/' || b.ticker AS pair, a.ts, row_number() OVER (PARTITION BY a.ticker, b.ticker ORDER BY a.ts) AS seq, a.close/b.close AS ratio, a.close AS num_close, b.close AS den_close FROM {src} a JOIN {src} b ON a.ts=b.ts AND a.ticker<b.ticker WHERE a.close IS NOT NULL AND b.close IS NOT NULL) "
S = PX + PAIRS.format(src="px")
SPARSE = "WITH sp AS (SELECT CAST(o_orderdate AS DATE) AS ts, o_orderpriority AS ticker, avg(o_totalprice) AS close FROM orders GROUP BY 1,2) "
BARS = (
    "WITH bars AS (SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS ts, min_by(l_extendedprice, (l_orderkey,l_linenumber,l_partkey,l_extendedprice)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, "
    "max_by(l_extendedprice, (l_orderkey,l_linenumber,l_partkey,l_extendedprice)) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1,2) "
)
_WP = "(PARTITION BY pair ORDER BY seq)"


def w(n: int) -> str:
    return f"(PARTITION BY pair ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int) -> str:
    fn = f"quantile_cont({x}, 0.5)" if f == "median" else f"{f}({x})"
    return f"CASE WHEN count({x}) OVER {w(n)} >= {n} THEN {fn} OVER {w(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {_WP}"


_HL = "(SELECT pair, count(*) AS n, CASE WHEN count(*)>=30 AND regr_slope(dx,px)<0 AND regr_slope(dx,px)>-1 THEN -ln(2)/ln(1+regr_slope(dx,px)) END AS hl FROM (SELECT pair, ratio-{l} AS dx, {l} AS px FROM s) GROUP BY 1)".format(l=lag("ratio"))
_WIN = "coalesce(least(greatest(CAST(floor(hl*0.5) AS BIGINT),10),252),0)"
HALFLIFE = f"SELECT pair, round(hl,6) AS halflife, {_WIN} AS \"window\" FROM {_HL}"
PASSTHROUGH = f"SELECT pair, round(hl,6) AS halflife, CASE WHEN {_WIN}>0 THEN {_WIN} ELSE 20 END AS \"window\", true AS passed FROM {_HL} WHERE n>=252"
ADF = (
    f", a AS (SELECT pair, seq, {lag('ratio')} AS x, ratio-{lag('ratio')} AS y FROM s), b AS (SELECT *, {lag('y')} AS z FROM a), g AS (SELECT pair, count(*)::DOUBLE AS n, covar_pop(x,x) xx, covar_pop(z,z) zz, covar_pop(x,z) xz, covar_pop(x,y) xy, covar_pop(z,y) zy, covar_pop(y,y) yy FROM b WHERE z IS NOT NULL GROUP BY 1), "
    "h AS (SELECT *, xx*zz-xz*xz AS det, (zz*xy-xz*zy)/(xx*zz-xz*xz) AS b1, (xx*zy-xz*xy)/(xx*zz-xz*xz) AS b2 FROM g) SELECT pair, round(b1/sqrt(greatest(n*(yy-b1*xy-b2*zy),0)/(n-3)*zz/(n*det)),6) AS adf_t FROM h"
)
ER = f", a AS (SELECT *, abs(ratio-{lag('ratio')}) AS st FROM s), b AS (SELECT pair, CASE WHEN {roll('sum', 'st', 10)} = 0 THEN 1.0 ELSE abs(ratio-{lag('ratio', 10)})/({roll('sum', 'st', 10)}) END AS er FROM a) SELECT pair, round(quantile_cont(er,0.5),6) AS median_er, coalesce(quantile_cont(er,0.5) < 0.3,false) AS passed FROM b GROUP BY 1 HAVING count(*)>=252"
_VRS = {q: f"var_samp(r{q})/var_samp(r1)*(count(*)-1)/({q}*(count(*)-{q}))" for q in (2, 5, 10, 20)}
VR = (
    ", a AS (SELECT pair, " + ", ".join(f"ln(ratio)-{lag('ln(ratio)', q)} AS r{q}" for q in (1, 2, 5, 10, 20)) + " FROM s), g AS (SELECT pair, " + ", ".join(f"{v} AS v{q}" for q, v in _VRS.items())
    + " FROM a GROUP BY 1 HAVING count(*)>=252) SELECT pair, " + ", ".join(f"round(v{q},6) AS vr_{q}" for q in _VRS) + ", round(list_median([v2,v5,v10,v20]),6) AS median_vr, list_median([v2,v5,v10,v20])<0.95 AS passed FROM g"
)
VOL_CONE = f", a AS (SELECT *, ratio/{lag('ratio')}-1 AS r FROM s), b AS (SELECT pair, seq, {roll('stddev_samp', 'r', 63)}*sqrt(252) AS v FROM a), c AS (SELECT pair, max_by(v,seq) FILTER (v IS NOT NULL) AS cur, count(*) AS n FROM b GROUP BY 1 HAVING count(*)>=252) SELECT c.pair, round(any_value(cur),6) AS current_vol, round(avg((v<cur)::INTEGER),6) AS share_below, avg((v<cur)::INTEGER) BETWEEN 0.1 AND 0.9 AS passed FROM b JOIN c ON b.pair=c.pair GROUP BY 1"


def _signal(ctes: str, source: str, entry: str, exit_: str) -> str:
    return S + ctes + f", f AS (SELECT pair, ts, seq, coalesce({entry},false) AS e, coalesce({exit_},false) AS x FROM {source}) SELECT pair, ts, coalesce({lag('e')},false) AS entry, coalesce({lag('x')},false) AS \"exit\" FROM f"


_M20, _SD20 = roll("avg", "ratio", 20), roll("stddev_samp", "ratio", 20)
_RSI = "a AS (SELECT *, ratio-{l} AS dx FROM s), b AS (SELECT *, {g} AS gn, {s} AS ls FROM a), c AS (SELECT *, 100-100/(1+gn/nullif(ls,0)) AS rsi FROM b)"


def _rsi(n: int) -> str:
    g, loss = "CASE WHEN dx IS NOT NULL THEN greatest(dx,0) END", "CASE WHEN dx IS NOT NULL THEN greatest(-dx,0) END"
    return ", " + _RSI.format(l=lag("ratio"), g=roll("avg", g, n), s=roll("avg", loss, n))


def signal(name: str) -> str | None:
    lo14, hi14 = roll("min", "ratio", 14), roll("max", "ratio", 14)
    lo20, hi20 = roll("min", "ratio", 20), roll("max", "ratio", 20)
    state = lambda on: _signal(f", a AS (SELECT *, coalesce({on},false) AS o FROM s)", "a", "o", "NOT o")
    prev = lambda f, n: f"CASE WHEN count(ratio) OVER (PARTITION BY pair ORDER BY seq ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)>={n} THEN {f}(ratio) OVER (PARTITION BY pair ORDER BY seq ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
    z = f", a AS (SELECT *, (ratio-{_M20})/nullif({_SD20},0) AS z FROM s)"
    med = f", m AS (SELECT *, {roll('median', 'ratio', 20)} AS md FROM s), m2 AS (SELECT *, abs(ratio-md) AS ad FROM m), a AS (SELECT *, (ratio-md)/nullif(1.4826*({roll('median', 'ad', 20)}),0) AS z FROM m2)"
    made = {
        "zscore_standard": lambda: _signal(z, "a", "z<=-2", "z>=0"),
        "zscore_robust_mad": lambda: _signal(med, "a", "z<=-2", "z>=0"),
        "bollinger": lambda: _signal(f", a AS (SELECT *, {_M20}-2*({_SD20}) AS lo, {_M20} AS hi FROM s)", "a", "ratio<=lo", "ratio>=hi"),
        "ma_crossover": lambda: state(f"ratio>{_M20}"),
        "dual_ma_crossover": lambda: state(f"({roll('avg', 'ratio', 19)})>({roll('avg', 'ratio', 60)})"),
        "momentum": lambda: state(f"ratio/{lag('ratio', 20)}-1>0"),
        "rsi_simple": lambda: _signal(_rsi(14), "c", "rsi<=30", "rsi>=60"),
        "cum_rsi": lambda: _signal(_rsi(2) + f", d AS (SELECT *, {roll('sum', 'rsi', 2)} AS cr, {roll('avg', 'ratio', 5)} AS m5 FROM c)", "d", "cr<=35", "coalesce(rsi>=65,false) OR coalesce(ratio>m5,false)"),
        "donchian": lambda: _signal(f", a AS (SELECT *, {prev('max', 20)} AS u, {prev('min', 10)} AS l FROM s)", "a", "ratio>=u", "ratio<=l"),
        "donchian_midline": lambda: _signal(f", a AS (SELECT *, {lo20} AS l, {hi20} AS h FROM s)", "a", "ratio<l+0.2*(h-l)", "ratio>=l+0.5*(h-l)"),
        "sma_distance": lambda: _signal(f", a AS (SELECT *, ratio/({roll('avg', 'ratio', 50)})-1 AS d FROM s)", "a", "d<-0.02", "d>0"),
        "stochastic_k": lambda: _signal(f", a AS (SELECT *, {lo14} AS l, {hi14} AS h FROM s), b AS (SELECT *, 100*(ratio-l)/nullif(h-l,0) AS kr FROM a), c AS (SELECT *, {roll('avg', 'kr', 3)} AS k FROM b)", "c", "k<20", "k>80"),
        "williams_r": lambda: _signal(f", a AS (SELECT *, {lo14} AS l, {hi14} AS h FROM s), b AS (SELECT *, -100*(h-ratio)/nullif(h-l,0) AS wr FROM a)", "b", "wr<-80", "wr>-20"),
    }
    return made[name]() if name in made else None


_WT = "PARTITION BY ticker ORDER BY ts"
HL_BAND = f"SELECT ticker, ts, coalesce(close < tp-2*wd,false) AS entry, coalesce(close>ph,false) AS \"exit\" FROM (SELECT *, CASE WHEN count(*) OVER n=10 THEN max(close) OVER n END AS tp, CASE WHEN count(*) OVER m=5 THEN avg(high-low) OVER m END AS wd, lag(high) OVER ({_WT}) AS ph FROM bars WINDOW n AS ({_WT} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), m AS ({_WT} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"
FRACTAL = f", o AS (SELECT ticker, ts, sum(coalesce(sign(dc),0)*volume) OVER ({_WT}) AS obv FROM (SELECT *, close-lag(close) OVER ({_WT}) AS dc FROM bars)) SELECT ticker, ts, kind FROM (SELECT ticker, ts, CASE WHEN count(*) OVER c<5 THEN NULL WHEN obv=max(obv) OVER c THEN 'top' WHEN obv=min(obv) OVER c THEN 'bottom' END AS kind FROM o WINDOW c AS ({_WT} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE kind IS NOT NULL"
STATE_MA = f", a AS (SELECT *, coalesce((ratio>{_M20})::INTEGER,0) AS p FROM s), b AS (SELECT pair, p, coalesce({lag('p')},0)*coalesce(ratio/{lag('ratio')}-1,0) AS r, (p>coalesce({lag('p')},0))::INTEGER AS op FROM a) SELECT pair, round(coalesce(avg(r)/nullif(stddev_samp(r),0)*sqrt(252),0),6) AS sharpe, CAST(sum(p) AS BIGINT) AS bars_in, CAST(sum(op) AS BIGINT) AS n_trades FROM b GROUP BY 1"
CPCV = (
    ", n AS (SELECT pair, count(*) AS n, count(*)//10 AS c FROM s GROUP BY 1), f AS (SELECT pair, k::INTEGER AS k, k*c AS lo, CASE WHEN k=9 THEN n ELSE (k+1)*c END AS hi FROM n, range(10) t(k) WHERE c>=20), "
    "i AS (SELECT pair, unnest(range(0,n)) AS i FROM n WHERE c>=20) SELECT i.pair, a.k AS f1, b.k AS f2, sum((NOT (i>=a.lo AND i<a.hi) AND NOT (i>=b.lo AND i<b.hi) AND NOT (i>=a.lo-20 AND i<a.lo+20) AND NOT (i>=a.hi-20 AND i<a.hi+20) AND NOT (i>=b.lo-20 AND i<b.lo+20) AND NOT (i>=b.hi-20 AND i<b.hi+20))::BIGINT)::BIGINT AS n_train, sum(((i>=a.lo AND i<a.hi) OR (i>=b.lo AND i<b.hi))::BIGINT)::BIGINT AS n_test "
    "FROM i JOIN f a ON a.pair=i.pair JOIN f b ON b.pair=i.pair AND a.k<b.k GROUP BY 1,2,3 HAVING n_train>=100"
)
BACKTEST = (
    "WITH RECURSIVE " + _PX + PAIRS.format(src="px") + f", a AS (SELECT *, (ratio-{_M20})/nullif({_SD20},0) AS z FROM s), f AS (SELECT pair, seq, num_close AS c, coalesce({lag('coalesce(z<=-2,false)')},false) AS e, coalesce({lag('coalesce(z>=0,false)')},false) AS x FROM a), "
    "m AS (SELECT pair, seq, c, false AS held, 0.0::DOUBLE AS ret, 0.0::DOUBLE AS run, NULL::DOUBLE AS tr FROM f WHERE seq=1 UNION ALL SELECT f.pair, f.seq, f.c, CASE WHEN m.held THEN NOT f.x ELSE f.e END, "
    "CASE WHEN m.held THEN f.c/m.c-1-CASE WHEN f.x THEN 0.001 ELSE 0 END WHEN f.e THEN -0.001 ELSE 0 END, CASE WHEN m.held THEN m.run+f.c/m.c-1-CASE WHEN f.x THEN 0.001 ELSE 0 END WHEN f.e THEN -0.001 ELSE 0 END, "
    "CASE WHEN m.held AND f.x THEN m.run+f.c/m.c-1-0.001 END FROM m JOIN f ON f.pair=m.pair AND f.seq=m.seq+1), "
    "q AS (SELECT *, exp(sum(ln(1+ret)) OVER (PARTITION BY pair ORDER BY seq)) AS eq, CASE WHEN held AND seq=max(seq) OVER (PARTITION BY pair) THEN run ELSE tr END AS t2 FROM m), d AS (SELECT *, eq/max(eq) OVER (PARTITION BY pair ORDER BY seq)-1 AS dd FROM q) "
    "SELECT pair, round(coalesce(avg(ret)/nullif(stddev_samp(ret),0)*sqrt(252),0),6) AS sharpe, round(pow(exp(sum(ln(1+ret))),252.0/count(*))-1,6) AS cagr, round(min(dd),6) AS max_dd, count(t2) AS n_trades, round(coalesce(avg((t2>0)::INTEGER),0),6) AS hit_rate, count(*) AS n_bars FROM d GROUP BY 1"
)
# Validation rows that reach every guard.
S3_ROWS = [
    ("A/B", 1.5, 0.3, 45, None, True, 0.65, "cpcv"),
    ("C/D", 0.4, 0.9, 8, 1200, True, 0.3, "wfa_expanding"),
    ("E/F", 0.9, 0.0, 8, 0, True, 0.8, "wfa_expanding"),
    ("G/H", -0.5, 0.2, 8, 900, True, 0.0, "wfa_rolling"),
    ("I/J", 1.1, 0.5, 1, 500, True, 0.55, "wfa_rolling"),
    ("K/L", 2.0, 0.4, 9, 800, False, 0.9, "cpcv"),
]
_S3_LITERAL = "SELECT * FROM (VALUES " + ",".join(f"('{p}',{m}::DOUBLE,{sd}::DOUBLE,{n}::BIGINT,{'NULL' if nb is None else nb}::BIGINT,{str(ok).lower()},{wf}::DOUBLE,'{vm}')" for p, m, sd, n, nb, ok, wf, vm in S3_ROWS) + ")"


def _s3() -> str:
    real = " UNION ALL ".join(f"SELECT pair || ' ' || val_method, mean_test_sharpe, std_test_sharpe, n_test_periods, n_oos_bars, true, wfe, val_method FROM ({validated(name)})" for name in ("wfa_expanding", "cpcv"))
    return f"WITH s3(pair,m,sd,n,nb,passed,wfe,vm) AS ({real} UNION ALL {_S3_LITERAL}) "


RET = (
    PX + ", " + _px("bp", "'BENCH'", "orders", "o_orderdate", "o_totalprice")
    + ", ret AS (SELECT key, ts, r FROM (SELECT ticker AS key, ts, close/nullif(lag(close) OVER (PARTITION BY ticker ORDER BY ts),0)-1 AS r FROM px WHERE close IS NOT NULL) WHERE r IS NOT NULL), br AS (SELECT ts, r AS b FROM (SELECT ts, close/nullif(lag(close) OVER (ORDER BY ts),0)-1 AS r FROM bp WHERE close IS NOT NULL) WHERE r IS NOT NULL) "
)
_K = "(PARTITION BY key ORDER BY ts)"
_CUM = f", cu AS (SELECT key, ts, r, exp(sum(ln(1+r)) OVER {_K}) AS cum FROM ret), cd AS (SELECT *, cum/max(cum) OVER {_K}-1 AS dd FROM cu) "
CORE = _CUM + "SELECT key, n, round(avg_r/sd*sqrt(252),6) AS sharpe, round(cagr,6) AS cagr, round(mdd,6) AS max_dd, round(sd*sqrt(252),6) AS volatility, round(coalesce(cagr/nullif(abs(mdd),0),0),6) AS calmar, round(coalesce(cagr/nullif(dn*sqrt(252),0),0),6) AS sortino FROM (SELECT key, count(*) AS n, avg(r) AS avg_r, stddev_samp(r) AS sd, pow(exp(sum(ln(1+r))),252.0/count(*))-1 AS cagr, min(dd) AS mdd, stddev_samp(r) FILTER (r<0) AS dn FROM cd GROUP BY 1)"
EQUITY = _CUM + (
    f", ru AS (SELECT key, max(n) AS run FROM (SELECT key, g, sum((dd<0)::INTEGER) AS n FROM (SELECT *, sum((dd>=0)::INTEGER) OVER {_K} AS g FROM cd) GROUP BY 1,2) GROUP BY 1) "
    "SELECT key, round(any_value(ul),6) AS ulcer, round(any_value(m3)/pow(any_value(m2),1.5)*sqrt(any_value(n)*(any_value(n)-1.0))/(any_value(n)-2),6) AS skew, round((any_value(n)-1.0)/((any_value(n)-2.0)*(any_value(n)-3.0))*((any_value(n)+1)*(any_value(m4)/pow(any_value(m2),2)-3)+6),6) AS kurtosis, round(any_value(inv),6) AS pct_invested, round(any_value(wr),6) AS win_rate, round(any_value(mx),6) AS best_day, round(any_value(mn),6) AS worst_day, CAST(any_value(run) AS BIGINT) AS max_dd_run "
    "FROM (SELECT c.key, count(*) AS n, sqrt(avg(pow(100*dd,2))) AS ul, avg(pow(r-mu,2)) AS m2, avg(pow(r-mu,3)) AS m3, avg(pow(r-mu,4)) AS m4, avg((r<>0)::INTEGER) AS inv, avg((r>0)::INTEGER) AS wr, max(r) AS mx, min(r) AS mn FROM cd c JOIN (SELECT key, avg(r) AS mu FROM ret GROUP BY 1) u ON u.key=c.key GROUP BY 1) JOIN ru USING (key) GROUP BY 1"
)
VS = (
    "SELECT key, n, round(beta,6) AS beta, round(te,6) AS tracking_error, round(uc,6) AS up_capture, round(dc,6) AS down_capture, round(ec,6) AS excess_cagr, round(co,6) AS correlation, round(mr-beta*mb,6) AS alpha, round(coalesce((mr-mb)/nullif(te,0),0),6) AS information_ratio, round(cg/beta,6) AS treynor, round(co*co,6) AS r2 FROM ("
    "SELECT key, count(*) AS n, regr_slope(r,b) AS beta, avg(r)*252 AS mr, avg(b)*252 AS mb, stddev_samp(r-b)*sqrt(252) AS te, avg(r) FILTER (b>0)/avg(b) FILTER (b>0) AS uc, avg(r) FILTER (b<0)/avg(b) FILTER (b<0) AS dc, pow(exp(sum(ln(1+r))),252.0/count(*))-pow(exp(sum(ln(1+b))),252.0/count(*)) AS ec, corr(r,b) AS co, pow(exp(sum(ln(1+r))),252.0/count(*))-1 AS cg FROM ret JOIN br USING (ts) GROUP BY 1)"
)
EXTENDED = (
    ", q AS (SELECT key, quantile_cont(r,0.05) AS v5, quantile_cont(r,0.01) AS v1, quantile_cont(r,0.95) AS q95, quantile_cont(r,0.25) AS q25, quantile_cont(r,0.5) AS md, quantile_cont(r,0.75) AS q75 FROM ret GROUP BY 1), "
    "g AS (SELECT key, any_value(v5) AS v5, any_value(v1) AS v1, avg(r) FILTER (r<=v5) AS cv, abs(any_value(q95/v5)) AS tr, sum(greatest(r,0))/sum(greatest(-r,0)) AS om, avg(r) FILTER (r>0) AS aw, avg(r) FILTER (r<0) AS al, avg((r>0)::INTEGER) AS wr, sum(r) FILTER (r>0)/abs(sum(r) FILTER (r<0)) AS pf, any_value(md) AS md, any_value(q75-q25) AS iqr FROM ret JOIN q USING (key) GROUP BY 1) "
    "SELECT key, round(v5,6) AS var_95, round(v1,6) AS var_99, round(cv,6) AS cvar_95, round(tr,6) AS tail_ratio, round(om,6) AS omega, round(aw,6) AS avg_win, round(al,6) AS avg_loss, round(wr,6) AS win_rate, round(pf,6) AS profit_factor, round(md,6) AS median, round(iqr,6) AS iqr, round(abs(aw/al),6) AS payoff, round(wr-(1-wr)/abs(aw/al),6) AS kelly FROM g"
)
STREAKS = f"SELECT key, coalesce(max(n) FILTER (s>0),0) AS longest_gain, coalesce(max(n) FILTER (s<0),0) AS longest_loss FROM (SELECT key, g, any_value(s) AS s, count(*) AS n FROM (SELECT *, sum(c) OVER {_K} AS g FROM (SELECT *, sign(r) AS s, (sign(r)<>coalesce(lag(sign(r)) OVER {_K},9))::INTEGER AS c FROM ret)) GROUP BY 1,2) GROUP BY 1"
_PER = ", pe AS (SELECT ticker AS key, CAST(date_trunc('{u}',ts) AS DATE) AS period, max_by(close,ts) AS last, min_by(close,ts) AS first FROM px WHERE close IS NOT NULL GROUP BY 1,2) "
MONTHLY = _PER.format(u="month") + ", mo AS (SELECT key, year(period) AS y, month(period) AS m, r FROM (SELECT *, last/lag(last) OVER (PARTITION BY key ORDER BY period)-1 AS r FROM pe) WHERE r IS NOT NULL) SELECT key, CAST(y AS INTEGER) AS year, " + ", ".join(f"round(max(r) FILTER (m={i}),6) AS m{i:02d}" for i in range(1, 13)) + ", round(exp(sum(ln(1+r)))-1,6) AS ytd FROM mo GROUP BY 1,2"
ANNUAL = _PER.format(u="year") + "SELECT key, CAST(year(period) AS INTEGER) AS year, round(last/coalesce(lag(last) OVER (PARTITION BY key ORDER BY period), first)-1,6) AS r FROM pe"
_W252 = "w AS (PARTITION BY key ORDER BY ts ROWS 251 PRECEDING)"
ROLLING = f"SELECT key, ts, round(CASE WHEN count(*) OVER w=252 THEN avg(r) OVER w/stddev_samp(r) OVER w*sqrt(252) END,6) AS rolling_sharpe, round(CASE WHEN count(*) OVER w=252 THEN avg(r) OVER w/(stddev_samp(CASE WHEN r<0 THEN r END) OVER w)*sqrt(252) END,6) AS rolling_sortino, round(CASE WHEN count(*) OVER w=252 THEN stddev_samp(r) OVER w*sqrt(252) END,6) AS rolling_vol FROM ret WINDOW {_W252}"
ROLLING_BETA = f"SELECT key, ts, round(CASE WHEN count(*) OVER w=252 THEN covar_samp(r,b) OVER w/var_samp(b) OVER w END,6) AS rolling_beta, round(CASE WHEN count(*) OVER w=252 THEN corr(r,b) OVER w END,6) AS rolling_corr FROM (SELECT key, ts, r, b FROM ret JOIN br USING (ts)) WINDOW {_W252}"
DRAWDOWNS = _CUM + f"SELECT key, valley_date, round(depth,6) AS depth, bars_under, row_number() OVER (PARTITION BY key ORDER BY depth, valley_date) AS rank FROM (SELECT key, g, arg_min(ts,(dd,ts)) AS valley_date, min(dd) AS depth, count(*) FILTER (dd<0) AS bars_under FROM (SELECT *, sum((dd>=0)::INTEGER) OVER {_K} AS g FROM cd) GROUP BY 1,2 HAVING min(dd)<0) QUALIFY rank<=10"
DECILE = ", j AS (SELECT key, r, b FROM ret JOIN br USING (ts)), e AS (SELECT key, list_distinct(quantile_cont(b,[0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1])) AS ed FROM j GROUP BY 1) SELECT key, greatest(1, len(list_filter(ed, lambda v: v < b)))::BIGINT AS bin, round(avg(r),6) AS mean_return, round(avg(b),6) AS mean_bench, count(*) AS n FROM j JOIN e USING (key) GROUP BY 1,2"
W6 = "WITH " + _px("p6", "l_returnflag || l_linestatus", "lineitem", "l_shipdate", "l_extendedprice") + ", ret6 AS (SELECT * FROM (SELECT ticker, ts, close/nullif(lag(close) OVER (PARTITION BY ticker ORDER BY ts),0)-1 AS r FROM p6 WHERE close IS NOT NULL) WHERE r IS NOT NULL), st AS (SELECT ticker, avg(r) AS mu, stddev_samp(r) AS sd FROM ret6 GROUP BY 1) "

# The published scheme names.
SCHEMES = (
    "WITH caps(c) AS (VALUES ('05'),('10'),('20'),('30'),('50')), plain(scheme,family,base) AS (VALUES ('equal_weight','static','equal'),('sharpe_weighted','static','sharpe'),('inverse_vol','static','invvol'),('hrp','static','hrp')), "
    "kinds(kind,family,base) AS (VALUES ('flat_1k','flat','equal'),('equal_dyn','dynamic','equal'),('sharpe_wt_dyn','dynamic','sharpe'),('inv_vol_dyn','dynamic','invvol'),('hrp','dynamic','hrp'),('roll_sr','rolling','sr'),('roll_iv','rolling','iv'),('roll_sortino','rolling','sortino'),('roll_calmar','rolling','calmar'),('roll_mom','rolling','mom'),('roll_er','rolling','er')) "
    "SELECT scheme, family, base, NULL::DOUBLE AS cap, 'cash_fraction_seq_capped' AS rule FROM plain UNION ALL SELECT kind || '_cap' || c, family, base, c::DOUBLE/100, 'cash_fraction_seq_capped' FROM kinds, caps"
)

_HALF = "CASE WHEN count(*)>=29 AND regr_slope(dx,px)<0 AND regr_slope(dx,px)>-1 THEN -ln(2)/ln(1+regr_slope(dx,px)) END"


def validated(name: str) -> str:
    """Validators that trade each part by itself: parts with their look-backs, then rolling z-scores with a
    frame of that length, then positions (entry and exit exclude each other, so the last flag decides)."""
    n = ", n AS (SELECT pair, count(*) AS n FROM s GROUP BY 1)"
    folds = {
        "wfa_expanding": "SELECT pair, k AS fold, 0 AS a, (k+1)*(n//9) AS b, (k+1)*(n//9) AS c, least((k+2)*(n//9), n) AS d FROM n, range(8) t(k) WHERE n//9 >= 20 AND (k+1)*(n//9) >= 50 AND least((k+2)*(n//9), n)-(k+1)*(n//9) >= 10",
        "wfa_rolling": "SELECT pair, k AS fold, k*180 AS a, k*180+504 AS b, k*180+504 AS c, k*180+684 AS d FROM n, range(30) t(k) WHERE k*180+684 <= n",
        "is_oos": "SELECT pair, 0 AS fold, 0 AS a, CAST(floor(n*0.8::DOUBLE) AS BIGINT) AS b, CAST(floor(n*0.8::DOUBLE) AS BIGINT) AS c, n AS d FROM n",
        "out_of_sample": "SELECT pair, 0 AS fold, 0 AS a, CAST(floor(n*0.8::DOUBLE) AS BIGINT) AS b, CAST(floor(n*0.8::DOUBLE) AS BIGINT) AS c, n AS d FROM n",
        "cpcv": "SELECT pair, k AS fold, k*(n//10) AS a, CASE WHEN k=9 THEN n ELSE (k+1)*(n//10) END AS b, 0 AS c, 0 AS d FROM n, range(10) t(k) WHERE n//10 >= 20",
    }[name]
    head = S + n + f", f AS ({folds})"
    if name == "cpcv":
        out = "s.seq-1 >= {0}.a AND s.seq-1 < {0}.b"
        near = "(s.seq-1 >= {0}.a-20 AND s.seq-1 < {0}.a+20) OR (s.seq-1 >= {0}.b-20 AND s.seq-1 < {0}.b+20)"
        head += (
            ", combos AS (SELECT x.pair, x.fold AS f1, y.fold AS f2, x.a AS a1, x.b AS b1, y.a AS a2, y.b AS b2 FROM f x JOIN f y ON x.pair=y.pair AND x.fold<y.fold)"
            f", tr AS (SELECT s.pair, f1, f2, seq, ratio FROM s JOIN f x USING (pair) JOIN f y USING (pair) JOIN combos c ON c.pair=s.pair AND c.f1=x.fold AND c.f2=y.fold WHERE NOT ({out.format('x')} OR {out.format('y')} OR {near.format('x')} OR {near.format('y')}))"
            ", hl AS (SELECT pair, f1, f2, count(*)+1 AS m, " + _HALF + " AS h FROM (SELECT pair, f1, f2, ratio-lag(ratio) OVER w AS dx, lag(ratio) OVER w AS px FROM tr WINDOW w AS (PARTITION BY pair, f1, f2 ORDER BY seq)) WHERE px IS NOT NULL GROUP BY 1,2,3)"
            ", seg AS (SELECT c.pair, f1*100+f2*10+k AS seg, f1, f2, k AS fold, CASE k WHEN f1 THEN a1 ELSE a2 END AS lo, CASE k WHEN f1 THEN b1 ELSE b2 END AS hi, coalesce(least(greatest(CAST(floor(h*0.5) AS BIGINT),10),252),20) AS w FROM combos c JOIN hl USING (pair, f1, f2), range(10) t(k) WHERE k IN (f1, f2) AND m >= 100)"
        )
    else:
        head += (
            ", hl AS (SELECT pair, fold, " + _HALF + " AS h FROM (SELECT f.pair, f.fold, ratio-lag(ratio) OVER w AS dx, lag(ratio) OVER w AS px FROM s JOIN f ON f.pair=s.pair AND s.seq-1 >= a AND s.seq-1 < b WINDOW w AS (PARTITION BY f.pair, f.fold ORDER BY seq)) WHERE px IS NOT NULL GROUP BY 1,2)"
            ", win AS (SELECT f.*, " + ("20" if name == "out_of_sample" else "coalesce(least(greatest(CAST(floor(h*0.5) AS BIGINT),10),252),20)") + " AS w FROM f LEFT JOIN hl USING (pair, fold))"
            ", seg AS (SELECT pair, fold*2 AS seg, fold, a AS lo, b AS hi, w FROM win UNION ALL SELECT pair, fold*2+1, fold, c, d, w FROM win)"
        )
    head += (
        ", bar AS (SELECT g.pair, g.seg, g.fold, s.seq, ratio, num_close, w FROM s JOIN seg g ON g.pair=s.pair AND s.seq-1 >= lo AND s.seq-1 < hi)"
        ", zz AS (SELECT *, CASE WHEN count(*) OVER v >= w AND stddev_samp(ratio) OVER v > 1e-10 THEN (ratio-avg(ratio) OVER v)/stddev_samp(ratio) OVER v END AS z FROM bar WINDOW v AS (PARTITION BY pair, seg ORDER BY seq ROWS BETWEEN w-1 PRECEDING AND CURRENT ROW))"
        ", fl AS (SELECT *, CASE WHEN lag(z) OVER o <= -2 THEN 1 WHEN lag(z) OVER o >= 0 THEN 0 END AS flag FROM zz WINDOW o AS (PARTITION BY pair, seg ORDER BY seq))"
        ", po AS (SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY pair, seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS pos FROM fl)"
        ", re AS (SELECT *, CASE WHEN coalesce(lag(pos) OVER o,0)=1 THEN num_close/lag(num_close) OVER o-1-CASE WHEN pos=0 THEN 0.001 ELSE 0 END WHEN pos=1 THEN -0.001 ELSE 0.0 END AS ret FROM po WINDOW o AS (PARTITION BY pair, seg ORDER BY seq))"
    )
    if name == "out_of_sample":
        return head + " SELECT pair, seq, round(ret,6) AS ret FROM re WHERE seg=1"
    sharpe = "CASE WHEN stddev_samp(ret)>1e-10 THEN avg(ret)/stddev_samp(ret)*sqrt(252) ELSE 0 END"
    if name == "cpcv":
        # Matching r: the pairs of 0 .. 8 with sum 2 r (mod 9), and {r, 9}.
        head += (
            ", paths AS (SELECT r AS path, x.f1, x.f2 FROM range(9) p(r), (SELECT DISTINCT f1, f2 FROM combos) x WHERE (x.f2=9 AND x.f1=r) OR (x.f2<9 AND (x.f1+x.f2-2*r)%9=0))"
            ", st AS (SELECT pair, path, re.fold, re.seq, ret FROM re JOIN seg USING (pair, seg) JOIN paths USING (f1, f2))"
            f", te AS (SELECT pair, path AS fold, {sharpe} AS sr, count(*) AS nb FROM st GROUP BY 1,2 HAVING count(DISTINCT st.fold)>=3)"
            ", oos AS (SELECT pair, seq, ret FROM st WHERE path=0), base AS (SELECT pair, 0.0 AS base FROM te GROUP BY 1)"
        )
    else:
        head += (
            f", sh AS (SELECT pair, seg, any_value(fold) AS fold, {sharpe} AS sr FROM re GROUP BY 1,2), te AS (SELECT pair, fold, sr FROM sh WHERE seg%2=1), base AS (SELECT pair, avg(sr) AS base FROM sh WHERE seg%2=0 GROUP BY 1)"
            ", oos AS (SELECT pair, seq, ret FROM re WHERE seg%2=1)"
        )
    method, positive = {"is_oos": "chan_is_oos"}.get(name, name), "true" if name == "is_oos" else "avg((sr>0)::INTEGER) >= 0.5"
    return head + (
        f", g AS (SELECT pair, avg(sr) AS m, coalesce(stddev_samp(sr),0) AS sd, count(*) AS n, avg((sr>0)::INTEGER) AS pp, avg(sr) >= 0 AND {positive} AS ok FROM te GROUP BY 1)"
        ", cv AS (SELECT pair, seq, ret, exp(sum(ln(1+ret)) OVER (PARTITION BY pair ORDER BY seq)) AS eq FROM oos), dd AS (SELECT *, eq/max(eq) OVER (PARTITION BY pair ORDER BY seq)-1 AS dd FROM cv)"
        ", o AS (SELECT pair, count(*) AS nb, pow(max_by(eq,seq),252.0/count(*))-1 AS cagr, min(dd) AS mdd FROM dd GROUP BY 1) "
        "SELECT g.pair, round(m,6) AS mean_test_sharpe, round(sd,6) AS std_test_sharpe, n AS n_test_periods, nb AS n_oos_bars, round(base,6) AS baseline_sharpe, round(CASE WHEN base>1e-6 THEN 1-m/base END,6) AS degradation, round(cagr,6) AS oos_cagr, round(mdd,6) AS oos_max_dd, round(pp,6) AS pct_positive, round(CASE WHEN base>0 AND m>0 THEN m/base ELSE 0 END,6) AS wfe, ok AS passed, "
        f"'{method}' AS val_method FROM g JOIN base USING (pair) JOIN o USING (pair)"
    )


S3 = _s3()


def phi(x: str) -> str:
    """The normal distribution function by its series, cut off at eight deviations."""
    return (
        f"(CASE WHEN ({x}) > 8 THEN 1.0 WHEN ({x}) < -8 THEN 0.0 ELSE 0.5 + exp(-({x})*({x})/2)/sqrt(2*pi()) * "
        f"list_sum(list_transform(range(0, 120), lambda k: ({x}) * pow(({x})*({x})/2, k::DOUBLE) * sqrt(pi()) / (2 * gamma(k + 1.5)))) END)"
    )


def adf_p(t: str) -> str:
    poly = f"CASE WHEN {t} <= -1.61 THEN 2.1659+1.4412*{t}+0.038269*{t}*{t} ELSE 1.7339+0.93202*{t}-0.12745*{t}*{t}-0.010368*{t}*{t}*{t} END"
    return f"CASE WHEN {t} = 0 OR {t} > 2.74 THEN 1.0 WHEN {t} < -18.83 THEN 0.0 ELSE {phi(poly)} END"


_N = "CASE WHEN nb > 0 THEN nb ELSE n END"
_ZPSR = "(m-({b}))*sqrt(nn-1.0)/sqrt(1+0.5*m*m)"
_TIERED = ", p > 0.95 AS passed, CASE WHEN p > 0.95 THEN 'TOP_TIER' ELSE 'REJECT' END AS tier"


def psr(star: str = "0.0") -> str:
    return f"(SELECT *, {star} AS star, CASE WHEN nn > 1 THEN {phi(_ZPSR.format(b=star))} ELSE 0 END AS p FROM (SELECT *, ({_N})::DOUBLE AS nn FROM s3 WHERE passed))"


PSR = S3 + f"SELECT pair, round(p,6) AS psr{_TIERED} FROM {psr()}"


def dsr(n_trials: float) -> str:
    from ..functions import stats

    unit = stats.expected_max_sharpe(stats.effective_trials(0.0, n_trials), 1.0)
    return S3 + f"SELECT pair, round(p,6) AS dsr, round(star,6) AS sr_star{_TIERED} FROM {psr(f'sqrt(CASE WHEN sd > 0 THEN sd*sd ELSE 0.25 END)*{unit!r}::DOUBLE')}"


MIN_TRL = S3 + "SELECT pair, round(CASE WHEN m > 0 THEN (1+(1+0.5*m*m)*pow(1.959963984540054/m,2))/252 END,6) AS min_trl_years, true AS passed, 'TOP_TIER' AS tier FROM s3 WHERE passed"
KPSS = (
    S + ", e AS (SELECT pair, seq, ratio-avg(ratio) OVER (PARTITION BY pair) AS e FROM s), l AS (SELECT pair, count(*) AS n, list(e ORDER BY seq) AS el FROM e GROUP BY 1 HAVING count(*)>=252), "
    "et AS (SELECT pair, sum(c*c) AS eta FROM (SELECT pair, sum(e) OVER (PARTITION BY pair ORDER BY seq) AS c FROM e) GROUP BY 1), "
    "a AS (SELECT *, list_transform(range(0, CAST(floor(pow(n,2.0/9)) AS BIGINT)+1), lambda k: list_dot_product(el[:n-k], el[k+1:])/n) AS f FROM l), "
    "b AS (SELECT *, f[1]+2*list_sum(f[2:]) AS s0, 2*list_sum(list_transform(range(1, len(f)), lambda k: k*f[k+1])) AS s1 FROM a), c AS (SELECT *, CAST(floor(1.1447*pow(pow(s1/s0,2),1.0/3)*pow(n,1.0/3)) AS INTEGER) AS lags FROM b), "
    "d AS (SELECT c.pair, lags, eta/(n::DOUBLE*n)/(f[1]+2*coalesce(list_sum(list_transform(range(1, lags+1), lambda k: list_dot_product(el[:n-k], el[k+1:])/n*(1-k/(lags+1.0)))),0)) AS st FROM c JOIN et USING (pair)), "
    "p AS (SELECT *, CASE WHEN st <= 0.347 THEN 0.10 WHEN st <= 0.463 THEN 0.10+(st-0.347)*((0.05-0.10)/(0.463-0.347)) WHEN st <= 0.574 THEN 0.05+(st-0.463)*((0.025-0.05)/(0.574-0.463)) WHEN st <= 0.739 THEN 0.025+(st-0.574)*((0.01-0.025)/(0.739-0.574)) ELSE 0.01 END AS p FROM d) "
    "SELECT pair, lags, round(st,6) AS kpss_stat, round(p,6) AS kpss_p, p >= 0.05 AS passed FROM p"
)
_ADF_OF = (
    "a{k} AS (SELECT {g}, seq, lag({v}) OVER w{k} AS x, {v}-lag({v}) OVER w{k} AS y FROM {src} WINDOW w{k} AS (PARTITION BY {g} ORDER BY seq)), b{k} AS (SELECT *, lag(y) OVER (PARTITION BY {g} ORDER BY seq) AS z FROM a{k}), "
    "g{k} AS (SELECT {g}, count(*)::DOUBLE AS n, covar_pop(x,x) xx, covar_pop(z,z) zz, covar_pop(x,z) xz, covar_pop(x,y) xy, covar_pop(z,y) zy, covar_pop(y,y) yy FROM b{k} WHERE z IS NOT NULL GROUP BY ALL), "
    "h{k} AS (SELECT *, xx*zz-xz*xz AS det, (zz*xy-xz*zy)/(xx*zz-xz*xz) AS b1, (xx*zy-xz*xy)/(xx*zz-xz*xz) AS b2 FROM g{k}), t{k} AS (SELECT {g}, b1/sqrt(greatest(n*(yy-b1*xy-b2*zy),0)/(n-3)*zz/(n*det)) AS t FROM h{k})"
)
_GRAM = "(SELECT {g}, list(r ORDER BY i) AS m FROM (SELECT {g}, i, list(s ORDER BY j) AS r FROM (SELECT {g}, i, j, sum(v[i]*v[j]) AS s FROM (SELECT *, unnest(range(1, len(v)+1)) AS i FROM {src}) q, range(1, 80) t(j) WHERE j <= len(v) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)"
#: Gaussian elimination of a list of lists, all columns but the last; a row stays as it was when its turn came.
_ELIMINATED = "list_reduce(list_transform(range(1, len(m)), lambda k: [[k::DOUBLE]]), lambda h, k: list_transform(range(1, len(h)+1), lambda i: list_transform(range(1, len(h)+1), lambda j: CASE WHEN i > k[1][1] THEN h[i][j]-h[i][k[1][1]::BIGINT]*h[k[1][1]::BIGINT][j]/h[k[1][1]::BIGINT][k[1][1]::BIGINT] ELSE h[i][j] END)), m)"
#: t{k}({g}, t, lag): the lag of least AIC up to {most} of n; all lags on one sample, the test on its own.
_ADF_AUTO = (
    "ra{k} AS (SELECT {g}, seq, {v} AS v0, count(*) OVER (PARTITION BY {g}) AS n, {v}-avg({v}) OVER (PARTITION BY {g}) AS c FROM {src} WHERE {v} IS NOT NULL), rb{k} AS (SELECT *, lag(c) OVER w AS x, c-lag(c) OVER w AS y FROM ra{k} WINDOW w AS (PARTITION BY {g} ORDER BY seq)), "
    "rc{k} AS (SELECT *, least({most}, n//2-2) AS most, row_number() OVER (PARTITION BY {g} ORDER BY seq) AS i, list(y) OVER (PARTITION BY {g} ORDER BY seq ROWS 80 PRECEDING) AS ys FROM rb{k}), "
    "rd{k} AS (SELECT {g}, n, most, [1.0, x] || list_reverse(ys[len(ys)-most:len(ys)-1]) || [y] AS v FROM rc{k} WHERE i >= most+2), "
    "re{k} AS (SELECT *, " + _ELIMINATED + " AS h FROM " + _GRAM.format(g="{g}", src="rd{k}") + "), "
    "rf{k} AS (SELECT {g}, list_transform(range(2, len(h)), lambda p: m[1][1]*ln((m[len(m)][len(m)]-list_sum(list_transform(range(1, p+1), lambda i: h[i][len(h)]*h[i][len(h)]/h[i][i])))/m[1][1])+2*p) AS aic FROM re{k}), "
    "rg{k} AS (SELECT {g}, list_position(aic, list_min(aic))-1 AS lag FROM rf{k}), "
    "rh{k} AS (SELECT {g}, lag, [1.0] || list_reverse(ys[len(ys)-lag:len(ys)-1]) || [x, y] AS v FROM rc{k} JOIN rg{k} USING ({g}) WHERE i >= lag+2), "
    "ri{k} AS (SELECT *, len(m) AS p, " + _ELIMINATED + " AS h FROM " + _GRAM.format(g="{g}", src="rh{k}") + "), "
    "t{k} AS (SELECT {g}, lag, h[p-1][p]/h[p-1][p-1]/sqrt(h[p][p]/(m[1][1]-lag-2)/h[p-1][p-1]) AS t FROM ri{k} JOIN rg{k} USING ({g}))"
)
_USUAL_LAGS = "ceil(12*pow(n/100.0, 0.25))::BIGINT"
_HL_OF = "l{k} AS (SELECT {g}, count(*) AS n, CASE WHEN count(*)>=30 AND regr_slope(dx,px)<0 AND regr_slope(dx,px)>-1 THEN -ln(2)/ln(1+regr_slope(dx,px)) END AS hl FROM (SELECT {g}, {v}-lag({v}) OVER w AS dx, lag({v}) OVER w AS px FROM {src} WINDOW w AS (PARTITION BY {g} ORDER BY seq)) GROUP BY ALL)"
CADF = (
    S + ", bb AS (SELECT pair, regr_slope(num_close, den_close) AS beta FROM s GROUP BY 1), e AS (SELECT s.pair, seq, num_close-beta*den_close AS e FROM s JOIN bb USING (pair)), " + _ADF_AUTO.format(k=1, g="pair", v="e", src="e", most=1) + ", " + _HL_OF.format(k=1, g="pair", v="e", src="e")
    + f" SELECT pair, round(beta,6) AS beta, round(t,6) AS adf_t, round({adf_p('t')},6) AS adf_p, round(hl,6) AS halflife, {_WIN} AS \"window\", coalesce({adf_p('t')} < 0.05, false) AS passed FROM bb JOIN t1 USING (pair) JOIN l1 USING (pair) WHERE n >= 252"
)
CHAN_HALFLIFE = (
    S + ", " + _ADF_AUTO.format(k=1, g="pair", v="ratio", src="s", most=1) + ", " + _HL_OF.format(k=1, g="pair", v="ratio", src="s")
    + f" SELECT pair, round(hl,6) AS halflife, {_WIN} AS \"window\", round(t,6) AS adf_t, round({adf_p('t')},6) AS adf_p, coalesce(hl BETWEEN 2 AND 756 AND {adf_p('t')} < 0.05, false) AS passed FROM t1 JOIN l1 USING (pair) WHERE n >= 252"
)
ADF_AUTO = S + ", " + _ADF_AUTO.format(k=1, g="pair", v="ratio", src="s", most=_USUAL_LAGS) + f" SELECT pair, round(t,6) AS adf_t, round({adf_p('t')},6) AS adf_p, lag::INTEGER AS lag FROM t1"
DSR_INPUTS = (
    S + ", p AS (SELECT s.pair AS unit, w AS combo, seq, coalesce((ratio > CASE w WHEN 10 THEN " + roll("avg", "ratio", 10) + " WHEN 20 THEN " + roll("avg", "ratio", 20) + " ELSE " + roll("avg", "ratio", 40)
    + " END)::INTEGER, 0) AS pos, coalesce(num_close/lag(num_close) OVER (PARTITION BY pair, w ORDER BY seq)-1, 0) AS r FROM (SELECT * FROM s, (VALUES (10),(20),(40)) v(w)) s), "
).replace("PARTITION BY pair ORDER BY seq ROWS", "PARTITION BY pair, w ORDER BY seq ROWS") + (
    "n AS (SELECT unit, combo, seq, coalesce(lag(pos) OVER o,0)*r-0.001*abs(pos-coalesce(lag(pos) OVER o,0)) AS net, count(*) OVER (PARTITION BY unit, combo) AS nn FROM p WINDOW o AS (PARTITION BY unit, combo ORDER BY seq)), "
    "c AS (SELECT x.unit, corr(x.net, y.net) AS c FROM n x JOIN n y ON x.unit=y.unit AND x.seq=y.seq AND x.combo<y.combo GROUP BY x.unit, x.combo, y.combo), "
    "i AS (SELECT unit, combo, avg(net)/stddev_pop(net)*sqrt(252) AS sr FROM n WHERE seq <= floor(nn*0.8::DOUBLE) GROUP BY 1,2) "
    "SELECT unit, 3::BIGINT AS n_combos, round(avg(c),6) AS mean_correlation, round(any_value(v),6) AS sr_variance, round(any_value(mx),6) AS max_sharpe FROM c JOIN (SELECT unit, var_samp(sr) AS v, max(sr) AS mx FROM i GROUP BY 1) USING (unit) GROUP BY 1"
)
CURVE_HASH = PX + "SELECT key, sha1(string_agg(v, ',' ORDER BY v)) AS curve_sha1 FROM (SELECT ticker AS key, printf('%s:%.6f', ts::VARCHAR, close/first(close) OVER (PARTITION BY ticker ORDER BY ts)) AS v FROM px WHERE close IS NOT NULL) GROUP BY 1"
DIVERSIFICATION = W6 + (
    ", w AS (SELECT ticker, 1.0::DOUBLE/count(*) OVER () AS w, sd FROM st), d AS (SELECT ts, sum(w*r) AS p, sum(w*r/sd) AS z, count(*) AS k FROM ret6 JOIN w USING (ticker) GROUP BY 1) "
    "SELECT round((SELECT sum(w*sd) FROM w)/stddev_samp(p),6) AS diversification_ratio, round(1/stddev_samp(z),6) AS diversification_multiplier FROM d WHERE k=(SELECT count(*) FROM st)"
)
REGIMES = (
    RET + ", lb AS (SELECT ts, coalesce((CASE WHEN count(*) OVER f=50 THEN avg(close) OVER f END > CASE WHEN count(*) OVER l=200 THEN avg(close) OVER l END)::INTEGER,0) AS regime FROM bp WHERE close IS NOT NULL WINDOW f AS (ORDER BY ts ROWS 49 PRECEDING), l AS (ORDER BY ts ROWS 199 PRECEDING)), "
    "j AS (SELECT key, regime, ts, r FROM ret JOIN lb USING (ts)), cu AS (SELECT *, exp(sum(ln(1+r)) OVER (PARTITION BY key, regime ORDER BY ts)) AS cum FROM j), cd AS (SELECT *, cum/max(cum) OVER (PARTITION BY key, regime ORDER BY ts)-1 AS dd FROM cu) "
    "SELECT key, regime::VARCHAR AS regime, count(*) AS n, round(avg(r)/stddev_samp(r)*sqrt(252),6) AS sharpe, round(pow(exp(sum(ln(1+r))),252.0/count(*))-1,6) AS cagr, round(min(dd),6) AS max_dd FROM cd GROUP BY 1,2 HAVING count(*)>=20"
)


def ewm(x: str, alpha: str, least: int, part: str = "pair") -> str:
    """Exponential weights from the first row on, brought to one scale by the row's number; missing values count as nothing."""
    w = f"(PARTITION BY {part} ORDER BY seq)"
    return f"CASE WHEN count({x}) OVER {w} >= {least} THEN sum({x}*pow(1-{alpha},-seq::DOUBLE)) OVER {w}/sum(CASE WHEN {x} IS NOT NULL THEN pow(1-{alpha},-seq::DOUBLE) END) OVER {w} END"


_D = f", d AS (SELECT *, ratio-{lag('ratio')} AS dx FROM s)"
_A14 = "1.0::DOUBLE/14"
_ADX = (
    _D + ", ax AS (SELECT *, CASE WHEN dx IS NOT NULL THEN greatest(dx,0) END AS up, CASE WHEN dx IS NOT NULL THEN greatest(-dx,0) END AS dn, abs(dx) AS tr FROM d)"
    + f", ay AS (SELECT *, nullif({ewm('tr', _A14, 14)},0) AS base, {ewm('up', _A14, 14)} AS u, {ewm('dn', _A14, 14)} AS v FROM ax), az AS (SELECT *, 100*abs(100*u/base-100*v/base)/nullif(100*u/base+100*v/base,0) AS dxi FROM ay), "
    + f"aa AS (SELECT *, {ewm('dxi', _A14, 14)} AS adx, (ratio-{_M20})/nullif({_SD20},0) AS z FROM az)"
)
_E21 = "2.0::DOUBLE/21"
_MORE_SIGNALS = {
    "ema_crossover": lambda: _signal(f", a AS (SELECT *, coalesce(ratio > {ewm('ratio', _E21, 20)}, false) AS o FROM s)", "a", "o", "NOT o"),
    "rsi_wilder": lambda: _signal(_D + ", c AS (SELECT *, CASE WHEN dx IS NOT NULL THEN greatest(dx,0) END AS gn, CASE WHEN dx IS NOT NULL THEN greatest(-dx,0) END AS ls FROM d)" + f", e AS (SELECT *, 100-100/(1+{ewm('gn', _A14, 14)}/nullif({ewm('ls', _A14, 14)},0)) AS rsi FROM c)", "e", "rsi<=30", "rsi>=60"),
    "adx_regime_gate": lambda: _signal(_ADX, "aa", "z<=-2", "z>=0.5*CASE WHEN coalesce(adx,30)>40 THEN 1.5 WHEN coalesce(adx,30)<20 THEN 0.5 ELSE 1 END"),
    "regime_switch": lambda: _signal(_ADX + f", rs AS (SELECT *, coalesce((ratio>{_M20})::INTEGER,0) AS o, coalesce(adx,22.5) AS g FROM aa), rt AS (SELECT *, coalesce({lag('o')},0) AS was FROM rs)", "rt", "(g<20 AND coalesce(z<=-2,false)) OR (g>25 AND o>was)", "(g<20 AND coalesce(z>=0,false)) OR (g>25 AND o<was)"),
    "atr_pullback": lambda: _signal(_D + f", e AS (SELECT *, abs(dx) AS ad FROM d), f AS (SELECT *, ({roll('max', 'ratio', 20)}-ratio)/nullif({ewm('ad', _A14, 14)},0) AS dp FROM e)".replace(" f AS", " ff AS"), "ff", "dp>=2", "dp<=0.5"),
    "keltner": lambda: _signal(
        _D + ", e AS (SELECT *, abs(dx) AS ad FROM d), ke AS (SELECT *, (ratio-CASE WHEN count(*) OVER o >= 20 THEN pow(1-2.0::DOUBLE/21,seq::DOUBLE)*sum(ratio*CASE WHEN seq=1 THEN pow(1-2.0::DOUBLE/21,-1.0) ELSE 2.0::DOUBLE/21*pow(1-2.0::DOUBLE/21,-seq::DOUBLE) END) OVER o END)"
        + f"/nullif({ewm('ad', _A14, 14)},0) AS z FROM e WINDOW o AS (PARTITION BY pair ORDER BY seq))", "ke", "z<=-2", "z>=0"),
    "vol_adaptive_zscore": lambda: _signal(
        f", a AS (SELECT *, ratio/{lag('ratio')}-1 AS r, (ratio-{_M20})/nullif({_SD20},0) AS z FROM s), b AS (SELECT *, {roll('stddev_samp', 'r', 20)} AS vol FROM a), c AS (SELECT *, count(vol) OVER h AS cv, list(vol) FILTER (vol IS NOT NULL) OVER h AS held FROM b WINDOW h AS (PARTITION BY pair ORDER BY seq ROWS 251 PRECEDING)), "
        "dd AS (SELECT *, 1+0.5*(coalesce(CASE WHEN cv>=20 AND vol IS NOT NULL THEN (len(list_filter(held, lambda v: v<vol))+(len(list_filter(held, lambda v: v=vol))+1)/2.0)/len(held) END,0.5)-0.5) AS sc FROM c)", "dd", "z<=-2*sc", "z>=0*sc"),
    "cointegration_spread": lambda: (
        _signal(f", a AS (SELECT *, (ratio-{_M20})/nullif({_SD20},0) AS z FROM s)", "a", "z<=-2", "z>=0").replace("SELECT pair, ts, coalesce(", ", " + _ADF_AUTO.format(k=1, g="pair", v="ratio", src="s", most=_USUAL_LAGS) + f", ok AS (SELECT pair, {adf_p('t')} <= 0.05 AS ok FROM t1) SELECT f.pair, ts, ok AND coalesce(", 1).replace(' AS entry, coalesce(', ' AS entry, ok AND coalesce(').replace('AS "exit" FROM f', 'AS "exit" FROM f JOIN ok USING (pair)')
    ),
}
_plain_signal = signal


def signal(name: str) -> str | None:  # noqa: F811
    return _MORE_SIGNALS[name]() if name in _MORE_SIGNALS else _plain_signal(name)


EXTENDED = (
    _CUM + f", lg AS (SELECT *, lag(r) OVER {_K} AS bf FROM cd), q AS (SELECT key, quantile_cont(r,0.05) AS v5, quantile_cont(r,0.01) AS v1, quantile_cont(r,0.95) AS q95, quantile_cont(r,0.99) AS q99, quantile_cont(r,0.25) AS q25, quantile_cont(r,0.5) AS md, quantile_cont(r,0.75) AS q75, avg(r)-1.6448536269514715*stddev_samp(r) AS pv5, avg(r)-2.3263478740408408*stddev_samp(r) AS pv1, avg(r) AS mu FROM ret GROUP BY 1), "
    "pit AS (SELECT key, avg(dd) AS pit FROM cd JOIN (SELECT key, avg(dd)-1.6448536269514715*stddev_samp(dd) AS cut FROM cd GROUP BY 1) USING (key) WHERE dd < cut GROUP BY 1), "
    "st AS (SELECT key, regr_r2(ln(cum), seq) AS stab FROM (SELECT key, cum, row_number() OVER (PARTITION BY key ORDER BY ts) AS seq FROM cd) GROUP BY 1), "
    "g AS (SELECT key, count(*)::DOUBLE AS n, any_value(mu) AS mu, stddev_samp(r) AS sd, sum(r) AS sm, min(dd) AS mdd, sqrt(sum(dd*dd)/(count(*)-1)) AS ul, sqrt(sum(r*r) FILTER (r<0)/count(*)) AS dn, avg(pow(r-mu,2)) AS m2, avg(pow(r-mu,3)) AS m3, avg(pow(r-mu,4)) AS m4, exp(sum(ln(1+r))) AS gr, corr(r,bf) AS ac, "
    "count(*) FILTER (r<>0) AS mv, count(*) FILTER (r>=0) AS fu, count(*) FILTER (r<0) AS nl, avg(r) FILTER (r>=0) AS um, sum(r) FILTER (r>=0) AS us, avg(r) FILTER (r<>0) AS ar, max(r) AS bd, min(r) AS wd, any_value(v5) AS v5, any_value(v1) AS v1, avg(r) FILTER (r<=v5) AS c5, avg(r) FILTER (r<=v1) AS c1, any_value(pv5) AS pv5, any_value(pv1) AS pv1, avg(r) FILTER (r<pv5) AS pc5, avg(r) FILTER (r<pv1) AS pc1, "
    "abs(any_value(q95/v5)) AS tr, any_value(q99) AS q99, sum(greatest(r,0))/sum(greatest(-r,0)) AS om, avg(r) FILTER (r>0) AS aw, avg(r) FILTER (r<0) AS al, avg((r>0)::INTEGER) AS wr, count(*) FILTER (r>0) AS nw, sum(r) FILTER (r<0) AS ls, any_value(md) AS md, any_value(q75-q25) AS iqr FROM lg JOIN q USING (key) GROUP BY 1), "
    "h AS (SELECT *, mu/sd AS sh, mu/dn AS so, nw/mv::DOUBLE AS ws, abs(aw/al) AS po, us/abs(ls) AS pf, m3/pow(m2,1.5)*sqrt(n*(n-1))/(n-2) AS sk, (n-1)/((n-2)*(n-3))*((n+1)*(m4/pow(m2,2)-3)+6) AS ku, sqrt(1+2*list_sum(list_transform(range(1,n::BIGINT), lambda k: (n-k)/n*pow(abs(ac),k::DOUBLE)))) AS pe FROM g JOIN pit USING (key) JOIN st USING (key)), "
    "z AS (SELECT *, sh/sqrt((1+0.5*sh*sh-sk*sh+(ku-3)/4*sh*sh)/(n-1)) AS z1, so/sqrt((1+0.5*so*so-sk*so+(ku-3)/4*so*so)/(n-1)) AS z2, so/sqrt(2)/sqrt((1+0.5*so*so/2-sk*so/sqrt(2)+(ku-3)/4*so*so/2)/(n-1)) AS z3 FROM h) "
    "SELECT key, " + ", ".join(f"round({v},6) AS {k}" for k, v in {
        "avg_return": "ar", "best_day": "bd", "worst_day": "wd", "var_95": "v5", "var_99": "v1", "cvar_95": "c5", "cvar_99": "c1", "parametric_var_95": "pv5", "parametric_var_99": "pv1", "parametric_cvar_95": "pc5", "parametric_cvar_99": "pc1", "tail_ratio": "tr", "omega": "om", "avg_win": "aw", "avg_loss": "al", "win_rate": "wr", "median": "md", "iqr": "iqr", "autocorr_lag1": "ac",
        "total_return": "gr-1", "geometric_mean": "pow(gr,1/n)-1", "rar": "(pow(gr,252/n)-1)/(ceil(mv/n*100)/100)", "smart_sharpe": "sh/pe*sqrt(252)", "smart_sortino": "so/pe*sqrt(252)", "adjusted_sortino": "so/sqrt(2)*sqrt(252)", "gain_to_pain": "sm/abs(ls)", "risk_return_ratio": "sh", "payoff_ratio": "po", "win_loss_ratio": "po", "payoff": "po", "kelly": "wr-(1-wr)/po",
        "serenity_index": "sm/(ul*(-pit/sd))", "upi": "(gr-1)/ul", "probabilistic_sharpe": phi("z1"), "probabilistic_sortino": phi("z2"), "probabilistic_adj_sortino": phi("z3"), "outlier_win_ratio": "q99/um", "outlier_loss_ratio": "v1/al", "win_share": "ws", "profit_ratio": "abs(um/fu)/abs(al/nl)", "profit_factor": "pf", "cpc_index": "pf*ws*po", "common_sense_ratio": "pf*tr",
        "kelly_criterion": "(po*ws-(1-ws))/po", "risk_of_ruin": "pow((1-ws)/(1+ws),n)", "recovery_factor": "abs(sm)/abs(mdd)", "stability_of_timeseries": "stab",
    }.items()) + " FROM z"
)
STRESS_ROWS = "(VALUES ('Dotcom_2000',DATE '2000-03-10',DATE '2000-09-10'),('9_11',DATE '2001-09-11',DATE '2001-10-11')) v(name,a,b)"

CADF_ROLLING = (
    S + ", n AS (SELECT pair, count(*) AS n FROM s GROUP BY 1), an AS (SELECT pair, unnest(range(252, n+1, 60)) AS anchor FROM n WHERE n >= 756), rw AS (SELECT an.pair, anchor, seq, num_close, den_close FROM s JOIN an ON an.pair=s.pair AND seq-1 >= anchor-252 AND seq-1 < anchor), "
    "bb AS (SELECT pair, anchor, regr_slope(num_close, den_close) AS beta FROM rw GROUP BY 1,2), e AS (SELECT rw.pair, rw.anchor, seq, num_close-beta*den_close AS e FROM rw JOIN bb USING (pair, anchor)), " + _ADF_OF.format(k=1, g="pair, anchor", v="e", src="e")
    + f" SELECT pair, count(*) AS n_windows, round(avg(({adf_p('t')} < 0.05)::INTEGER),6) AS pass_rate, round(avg(beta),6) AS mean_beta, round(stddev_pop(beta),6) AS std_beta, count(*) >= 4 AND avg(({adf_p('t')} < 0.05)::INTEGER) >= 0.5 AS passed FROM t1 JOIN bb USING (pair, anchor) WHERE beta IS NOT NULL GROUP BY 1"
)
_HURST = (
    ", hr AS (SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY seq)-1 AS i, r FROM (SELECT pair, seq, ln(ratio/lag(ratio) OVER (PARTITION BY pair ORDER BY seq)) AS r FROM s) WHERE r IS NOT NULL), hn AS (SELECT pair, count(*) AS n FROM hr GROUP BY 1 HAVING count(*) >= 50), "
    "hl0 AS (SELECT DISTINCT pair, n, CAST(floor(pow(10.0, 0.5+k*(log10(n/2.0)-0.5)/49)) AS BIGINT) AS lg FROM hn, range(50) t(k)), hc AS (SELECT hr.pair, lg, i//lg AS ch, i, r FROM hr JOIN hl0 ON hl0.pair=hr.pair AND lg >= 2 WHERE (i//lg+1)*lg <= n), "
    "hd AS (SELECT *, avg(r) OVER c AS m, stddev_samp(r) OVER c AS sd FROM hc WINDOW c AS (PARTITION BY pair, lg, ch)), hu AS (SELECT pair, lg, ch, sd, sum(r-m) OVER (PARTITION BY pair, lg, ch ORDER BY i) AS cu FROM hd), "
    "hs AS (SELECT pair, lg, avg(rs) AS rs FROM (SELECT pair, lg, ch, (max(cu)-min(cu))/nullif(max(sd),0) AS rs FROM hu GROUP BY 1,2,3) WHERE rs > 0 GROUP BY 1,2), hh AS (SELECT pair, CASE WHEN count(*) >= 5 THEN regr_slope(log10(rs), log10(lg)) END AS hurst FROM hs GROUP BY 1)"
)
HURST = S + _HURST + f" SELECT pair, round(hurst,6) AS hurst, round(hl,6) AS halflife, {_WIN} AS \"window\", coalesce(hurst < 0.5, false) AS passed FROM hh JOIN {_HL} h USING (pair) WHERE n >= 252"
HURST_TREND = S + _HURST + f" SELECT pair, round(hurst,6) AS hurst, round(hl,6) AS halflife, 0 AS \"window\", coalesce(hurst > 0.5, false) AS passed FROM hh JOIN {_HL} h USING (pair) WHERE n >= 252"


def grid_ma(kind: str) -> str:
    """All look-backs at once: rows times windows, each with a frame of its own length."""
    frame = "ROWS BETWEEN w-1 PRECEDING AND CURRENT ROW"
    mean = "CASE WHEN count(*) OVER v >= w THEN avg(ratio) OVER v END"
    short = "CASE WHEN count(*) OVER u >= greatest(w//3,2) THEN avg(ratio) OVER u END"
    ema = "CASE WHEN seq >= w THEN sum(ratio*pow(1-2.0::DOUBLE/(w+1),-seq::DOUBLE)) OVER o/sum(pow(1-2.0::DOUBLE/(w+1),-seq::DOUBLE)) OVER o END"
    on = {"sma": f"ratio > {mean}", "dual": f"{short} > {mean}", "ema": f"ratio > {ema}", "momentum": "ratio/lag(ratio, w) OVER o-1 > 0"}[kind]
    sharpe = "CASE WHEN stddev_samp(net) > 1e-10 THEN avg(net)/stddev_samp(net)*sqrt(252) ELSE 0 END"
    return S + (
        ", n AS (SELECT pair, count(*) AS n, CAST(floor(count(*)*0.8::DOUBLE) AS BIGINT) AS cut FROM s GROUP BY 1), g AS (SELECT s.pair, seq, ratio, t.w FROM s, range(10,271) t(w)), "
        f"f AS (SELECT pair, w, seq, coalesce(ratio/lag(ratio) OVER o-1,0) AS r, coalesce({on}, false)::INTEGER AS o1 FROM g WINDOW o AS (PARTITION BY pair, w ORDER BY seq), v AS (PARTITION BY pair, w ORDER BY seq {frame}), u AS (PARTITION BY pair, w ORDER BY seq ROWS BETWEEN greatest(w//3,2)-1 PRECEDING AND CURRENT ROW)), "
        "p AS (SELECT f.pair, w, seq, cut, r*coalesce(lag(o1) OVER (PARTITION BY f.pair, w ORDER BY seq),0) AS net FROM f JOIN n ON n.pair=f.pair), "
        f"b AS (SELECT pair, w, round({sharpe},12) AS sr FROM p WHERE seq <= cut GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY pair ORDER BY sr DESC, w)=1), "
        "x AS (SELECT p.pair, p.w, b.sr, seq, net FROM p JOIN b ON b.pair=p.pair AND b.w=p.w WHERE seq > cut), y AS (SELECT *, lag(net,5) OVER (PARTITION BY pair ORDER BY seq) AS l5, exp(sum(ln(1+net)) OVER (PARTITION BY pair ORDER BY seq)) AS eq FROM x), z AS (SELECT *, eq/max(eq) OVER (PARTITION BY pair ORDER BY seq)-1 AS dd FROM y) "
        f"SELECT pair, any_value(w) AS \"window\", round(any_value(sr),6) AS is_sharpe, round({sharpe},6) AS oos_sharpe, round(pow(1+avg(net),252)-1,6) AS oos_cagr, round(min(dd),6) AS oos_max_dd, round(avg((net<>0)::INTEGER),6) AS oos_exposure, round(coalesce(corr(net,l5),0),6) AS lag5_autocorr, {sharpe} > 0 AS passed FROM z GROUP BY 1"
    )


_REC = "WITH RECURSIVE " + _PX + PAIRS.format(src="px")


def _held_signal(ctes: str, source: str, entry: str, natural: str, most: int) -> str:
    """Flags one bar later, and an exit ``most`` bars after an entry without a natural one, bar by bar."""
    return _REC + ctes + (
        f", g AS (SELECT pair, ts, seq, coalesce({entry},false) AS e0, coalesce({natural},false) AS x0 FROM {source}), f AS (SELECT pair, ts, seq, coalesce({lag('e0')},false) AS e, coalesce({lag('x0')},false) AS x FROM g), "
        "m AS (SELECT pair, seq, CASE WHEN e THEN 0 ELSE -1 END AS held, false AS forced FROM f WHERE seq=1 UNION ALL SELECT f.pair, f.seq, CASE WHEN m.held < 0 THEN CASE WHEN f.e THEN 0 ELSE -1 END WHEN f.x THEN -1 "
        f"WHEN m.held+1 >= {most} THEN -1 ELSE m.held+1 END, m.held >= 0 AND NOT f.x AND m.held+1 >= {most} FROM m JOIN f ON f.pair=m.pair AND f.seq=m.seq+1) "
        'SELECT f.pair, f.ts, e AS entry, x OR forced AS "exit" FROM f JOIN m ON m.pair=f.pair AND m.seq=f.seq'
    )


# The adaptive mean from its seed at index 10: efficiency over ten bars, then one bar after the other.
_KAMA = (
    ", kd AS (SELECT *, abs(ratio-{l1}) AS st FROM s), ke AS (SELECT *, CASE WHEN sum(st) OVER (PARTITION BY pair ORDER BY seq ROWS {b} PRECEDING) > 0 THEN abs(ratio-lag(ratio,{n}) OVER (PARTITION BY pair ORDER BY seq))/sum(st) OVER (PARTITION BY pair ORDER BY seq ROWS {b} PRECEDING) ELSE 0 END AS er FROM kd), "
    "km AS (SELECT pair, seq, ratio AS kama FROM ke WHERE seq={n}+1 UNION ALL SELECT k.pair, k.seq, m.kama+pow(k.er*(2.0::DOUBLE/3-2.0::DOUBLE/31)+2.0::DOUBLE/31,2)*(k.ratio-m.kama) FROM km m JOIN ke k ON k.pair=m.pair AND k.seq=m.seq+1)"
)


def _kama(n: int) -> str:
    return _KAMA.format(l1=lag("ratio"), n=n, b=n - 1)


# The level filter's gain settles by itself: p, then p + q before each update.
_LEVEL = (
    ", lv AS (SELECT pair, seq, ratio AS level, 0.5::DOUBLE AS p FROM s WHERE seq=1 UNION ALL SELECT s.pair, s.seq, lv.level+(lv.p+0.01)/(lv.p+1.01)*(s.ratio-lv.level), (lv.p+0.01)*(1-(lv.p+0.01)/(lv.p+1.01)) FROM lv JOIN s ON s.pair=lv.pair AND s.seq=lv.seq+1), "
    "rz AS (SELECT s.pair, s.ts, s.seq, s.ratio-level AS v FROM s JOIN lv ON lv.pair=s.pair AND lv.seq=s.seq), "
)
_MORE_SIGNALS |= {
    "nday_low": lambda: _held_signal(f", a AS (SELECT *, {roll('min', 'ratio', 7)} AS lo, {roll('max', 'ratio', 7)} AS hi, {roll('avg', 'ratio', 200)} AS sm FROM s)", "a", "ratio<=lo AND ratio>sm", "ratio>=hi", 10),
    "kama_crossover": lambda: (_REC + _kama(20) + ", a AS (SELECT s.pair, s.ts, s.seq, coalesce(s.ratio > kama, false) AS o FROM s LEFT JOIN km ON km.pair=s.pair AND km.seq=s.seq) " + f"SELECT pair, ts, coalesce({lag('o')},false) AS entry, coalesce({lag('NOT o')},false) AS \"exit\" FROM a"),
    "kalman_hedge": lambda: (
        _REC + _LEVEL + f"m1 AS (SELECT *, {roll('median', 'v', 20)} AS md FROM rz), m2 AS (SELECT *, abs(v-md) AS ad FROM m1), a AS (SELECT *, (v-md)/nullif(1.4826*({roll('median', 'ad', 20)}),0) AS z FROM m2), f AS (SELECT pair, ts, seq, coalesce(z<=-2,false) AS e, coalesce(z>=0,false) AS x FROM a) "
        f"SELECT pair, ts, coalesce({lag('e')},false) AS entry, coalesce({lag('x')},false) AS \"exit\" FROM f"
    ),
}
KAUFMAN_KAMA = (
    _REC + _kama(10) + f", a AS (SELECT ke.pair, ke.seq, er, (ke.ratio > kama)::INTEGER AS ab, kama, CASE WHEN ke.seq > 10 THEN er END AS e10 FROM ke LEFT JOIN km ON km.pair=ke.pair AND km.seq=ke.seq), b AS (SELECT *, (ab <> {lag('ab')})::INTEGER AS cr, kama/nullif({lag('kama', 10)},0)-1 AS sl FROM a) "
    "SELECT pair, round(avg(e10),6) AS mean_er, CAST(sum(cr) AS BIGINT) AS crossings, round(sum(cr)/count(kama)::DOUBLE*252,6) AS per_year, round(avg(sl),6) AS kama_slope, coalesce(avg(e10) < 0.15 AND sum(cr)/count(kama)::DOUBLE*252 >= 4, false) AS passed FROM b GROUP BY 1"
)

CHAN_COMBINED = (
    f"SELECT c.pair, c.halflife, c.\"window\", c.passed AS passed_base, coalesce(h.passed,false) AS passed_hurst, coalesce(e.passed,false) AS passed_er, c.passed AND coalesce(h.passed,false) AND coalesce(e.passed,false) AS passed "
    f"FROM ({CHAN_HALFLIFE}) c LEFT JOIN ({HURST}) h USING (pair) LEFT JOIN ({S + ER}) e USING (pair)"
)
TREND_COMBINED = (
    f"SELECT e.pair, median_er, e.passed AS passed_base, coalesce(h.passed,false) AS passed_hurst, e.passed AND coalesce(h.passed,false) AS passed FROM ({S + ER.replace('< 0.3', '> 0.3')}) e LEFT JOIN ({HURST_TREND}) h USING (pair)"
)

CHECKS = (
    S + ", m AS (SELECT pair, date_trunc('month', ts) AS month, coalesce(avg(r),0) AS mu, coalesce(avg((r>0)::INTEGER),0) AS w FROM (SELECT pair, ts, ratio/nullif(lag(ratio) OVER (PARTITION BY pair ORDER BY seq),0)-1 AS r FROM s) GROUP BY 1,2), "
    "v AS (SELECT 's1_pass_rate' AS c, avg((mu>0)::INTEGER)::DOUBLE AS x, 0.05::DOUBLE AS lo, 0.95::DOUBLE AS hi, 'warn' AS sev FROM m UNION ALL SELECT 's2_oos_sr', quantile_cont(mu*1000,0.5), NULL, 2.0, 'strict' FROM m UNION ALL SELECT 's3_fold_win_rate', quantile_cont(w,0.5), 0.5, NULL, 'warn' FROM m "
    "UNION ALL SELECT 's3_cohort_size', sum((mu>0)::INTEGER)::DOUBLE, 50.0, NULL, 'warn' FROM m UNION ALL SELECT 's4_pass_rate', avg((mu>0.01)::INTEGER)::DOUBLE, 0.05, 0.9, 'strict' FROM m UNION ALL SELECT 's5_ir_vs_spy', max(mu-1), 0.0, NULL, 'strict' FROM m UNION ALL SELECT 's5_locked_sr', max(mu*10), 0.5, NULL, 'warn' FROM m) "
    "SELECT c AS \"check\", round(x,6) AS value, lo AS low, hi AS high, sev AS severity, NOT (coalesce(x<lo,false) OR coalesce(x>hi,false)) AS ok FROM v"
)
ROWS = (
    S + ", sm AS (SELECT *, month(ts) AS mo FROM s), st AS (SELECT pair, mo, ratio-lag(ratio) OVER w AS dx, lag(ratio) OVER w AS px FROM sm WINDOW w AS (PARTITION BY pair ORDER BY seq)), "
    "h AS (SELECT pair, mo, CASE WHEN count(*)>=30 AND regr_slope(dx,px)<0 AND regr_slope(dx,px)>-1 THEN -ln(2)/ln(1+regr_slope(dx,px)) END AS hl FROM st GROUP BY 1,2), "
    "r AS (SELECT *, mo=1 AS a, mo=2 AS b, coalesce(least(greatest(floor(hl*0.5),10),252),0)<1 AS c, mo=3 AS e FROM h), "
    "n AS (SELECT 'numerator: null' AS rule, count(*) FILTER (a) AS n FROM r UNION ALL SELECT 'passed: type', count(*) FILTER (b) FROM r UNION ALL SELECT 'window: low', count(*) FILTER (c) FROM r UNION ALL SELECT 'method: null', count(*) FILTER (e) FROM r) "
    "SELECT rule, n, least(n,5) AS examples FROM n WHERE n>0 UNION ALL SELECT 'good', count(*) FILTER (NOT (a OR b OR c OR e)), 0 FROM r"
)

DSR_INPUTS_OHLC = (
    BARS + ", q AS (SELECT *, row_number() OVER w AS seq, count(*) OVER (PARTITION BY ticker) AS nn, coalesce(close/nullif(lag(close) OVER w,0)-1,0) AS r FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)), "
    "t AS (SELECT ticker, seq, sum(close) OVER (PARTITION BY ticker ORDER BY seq) AS c FROM q), a AS (SELECT q.*, v.w, CASE WHEN q.seq >= v.w THEN (t.c-coalesce(u.c,0))/v.w END AS mean FROM q JOIN t USING (ticker, seq) CROSS JOIN range(10,110,10) v(w) LEFT JOIN t u ON u.ticker=q.ticker AND u.seq=q.seq-v.w), "
    "p AS (SELECT ticker AS unit, w*100+s AS combo, seq, nn, r, coalesce((close-low < s/20.0::DOUBLE*(high-low) AND close > mean)::INTEGER,0) AS pos FROM a CROSS JOIN range(6,16) x(s) WHERE nn >= 250), "
    "n AS (SELECT unit, combo, seq, nn, coalesce(lag(pos) OVER o,0)*r-CASE WHEN seq=1 THEN 0 ELSE 0.001*abs(pos-coalesce(lag(pos) OVER o,0)) END AS net FROM p WINDOW o AS (PARTITION BY unit, combo ORDER BY seq)), "
    "g AS (SELECT unit, combo, avg(net) AS mu, stddev_pop(net) AS sd, any_value(nn) AS nn FROM n GROUP BY 1,2 HAVING stddev_pop(net) > 1e-10), "
    "z AS (SELECT n.unit, n.seq, sum((net-mu)/sd) AS z, count(*) AS k FROM n JOIN g USING (unit, combo) GROUP BY 1,2), c AS (SELECT unit, max(k) AS k, avg(z*z) AS v FROM z GROUP BY 1), "
    "i AS (SELECT unit, combo, avg(net)/stddev_pop(net)*sqrt(252) AS sr FROM n JOIN g USING (unit, combo) WHERE seq <= floor(n.nn*0.8::DOUBLE) GROUP BY 1,2 HAVING stddev_pop(net) > 1e-10) "
    "SELECT unit, k AS n_combos, round((v-k)/(k*(k-1)),6) AS mean_correlation, round(var,6) AS sr_variance, round(mx,6) AS max_sharpe FROM c JOIN (SELECT unit, var_samp(sr) AS var, max(sr) AS mx FROM i GROUP BY 1) USING (unit)"
)

LIVE_LINES = (
    S + ", b AS (SELECT pair, seq-1 AS i, ratio, lead(ratio,25) OVER (PARTITION BY pair ORDER BY seq) AS later FROM s), l AS (SELECT pair, i, ratio, (later-ratio)/25 AS m FROM b WHERE i % 25 = 0 AND later IS NOT NULL) "
    "SELECT b.pair, b.i::INTEGER AS seq, CASE WHEN m < 0 THEN 'resistance' ELSE 'support' END AS kind, count(*) AS n_live, round(min(l.ratio+m*(b.i-l.i)),6) AS lowest, round(max(l.ratio+m*(b.i-l.i)),6) AS highest FROM b JOIN l ON b.pair=l.pair AND b.i > l.i+25 AND b.i <= l.i+145 GROUP BY 1,2,3"
)

#: trades(pair, trade, entry_ts, exit_ts, bars, pnl) of the z-score backtest.
TRADES = BACKTEST[: BACKTEST.index("SELECT pair, round(coalesce(avg(ret)")] + (
    ", o AS (SELECT d.*, s.ts, (held AND NOT coalesce(lag(held) OVER w, false))::INTEGER AS op FROM d JOIN s USING (pair, seq) WINDOW w AS (PARTITION BY pair ORDER BY seq)), k AS (SELECT *, sum(op) OVER (PARTITION BY pair ORDER BY seq)::BIGINT AS trade FROM o), "
    "trades AS (SELECT pair, trade, min(ts) FILTER (op=1) AS entry_ts, max(ts) FILTER (t2 IS NOT NULL) AS exit_ts, (max(seq) FILTER (t2 IS NOT NULL)-min(seq) FILTER (op=1))::BIGINT AS bars, sum(t2) AS pnl FROM k WHERE trade > 0 GROUP BY 1,2 HAVING max(ts) FILTER (t2 IS NOT NULL) IS NOT NULL) "
)
_DRAWN = (
    RET + ", hv AS (SELECT key, list(r ORDER BY ts) AS v FROM ret GROUP BY 1), pq AS (SELECT key, v, p, unnest(range(0, (({steps})+3)//4)) AS q FROM hv, range(0,{samples}) t(p)), dg AS (SELECT *, md5('42|' || key || '|' || p || '|' || q) AS h FROM pq), "
    "dr AS (SELECT key, p, q*4+j AS step, v[('0x' || substr(h, 1+8*j::INTEGER, 8))::BIGINT % len(v) + 1] AS r FROM dg, range(0,4) u(j) WHERE q*4+j < ({steps})), eq AS (SELECT *, exp(sum(ln(greatest(1+r,1e-12))) OVER (PARTITION BY key, p ORDER BY step)) AS e FROM dr) "
)
CONE = _DRAWN.format(steps="252", samples=1000) + "SELECT key, step+1 AS step, round(quantile_cont(e,0.05),6) AS p05, round(quantile_cont(e,0.25),6) AS p25, round(quantile_cont(e,0.5),6) AS p50, round(quantile_cont(e,0.75),6) AS p75, round(quantile_cont(e,0.95),6) AS p95 FROM eq GROUP BY 1,2"
BOOTSTRAP = _DRAWN.format(steps="len(v)", samples=200) + (
    ", ud AS (SELECT *, e/max(e) OVER (PARTITION BY key, p ORDER BY step)-1 AS dd FROM eq), mt AS (SELECT key, p, coalesce(CASE WHEN stddev_samp(r)>1e-10 THEN avg(r)/stddev_samp(r)*sqrt(252) END,0) AS sharpe, pow(max_by(e,step),252.0/count(*))-1 AS cagr, coalesce(stddev_samp(r)*sqrt(252),0) AS volatility, min(dd) AS max_dd FROM ud GROUP BY 1,2), "
    "ml AS (UNPIVOT (SELECT key, p, sharpe, cagr, volatility, max_dd, coalesce(cagr/nullif(-max_dd,0),0) AS calmar FROM mt) ON sharpe, cagr, volatility, max_dd, calmar INTO NAME metric VALUE x) "
    "SELECT key, metric, round(quantile_cont(x,0.05),6) AS p05, round(quantile_cont(x,0.5),6) AS p50, round(quantile_cont(x,0.95),6) AS p95 FROM ml GROUP BY 1,2"
)
PERIOD_HISTOGRAM = (
    RET + ", pe AS (SELECT ticker AS key, date_trunc('week',ts) AS period, max_by(close,ts) AS e FROM px WHERE close IS NOT NULL GROUP BY 1,2), pr AS (SELECT key, 100*(e/nullif(lag(e) OVER (PARTITION BY key ORDER BY period),0)-1) AS x FROM pe), "
    "pb AS (SELECT key, x, (CASE WHEN x < -1 THEN 0 WHEN x > 1 THEN 9 ELSE least(floor((x+1)/0.25::DOUBLE)+1,8) END)::INTEGER AS bin FROM pr WHERE x IS NOT NULL) "
    "SELECT key, bin, CASE WHEN bin > 0 THEN round(-1+(bin-1)*0.25::DOUBLE,6) END AS low, CASE WHEN bin <= 8 THEN round(-1+bin*0.25::DOUBLE,6) END AS high, n, round(mu,6) AS mean_pct, round(sd,6) AS sd_pct FROM (SELECT key, bin, count(*) AS n FROM pb GROUP BY 1,2) JOIN (SELECT key, avg(x) AS mu, stddev_samp(x) AS sd FROM pb GROUP BY 1) USING (key)"
)

RESOLVED = (
    "WITH v AS (SELECT pair, mean_test_sharpe AS x, degradation AS d, passed AS p, val_method AS m FROM (" + validated("wfa_expanding") + ") UNION ALL SELECT pair, mean_test_sharpe, degradation, passed, val_method FROM (" + validated("is_oos") + ")), "
    "g AS (SELECT pair, count(*) AS n, count(*) FILTER (p) AS k, string_agg(m, ',' ORDER BY m) AS ms, min(x) AS low, max(d) AS worst, max_by(x,x) AS ax, max_by(d,x) AS ad, max_by(x,x) FILTER (p) AS gx, max_by(d,x) FILTER (p) AS gd, max(x) FILTER (m='chan_is_oos') AS s1, max(x) FILTER (m='wfa_expanding') AS s2 FROM v GROUP BY 1) "
    "SELECT pair, k>0 AS passed, CASE WHEN k=n THEN low WHEN k>0 THEN gx ELSE ax END AS sharpe, CASE WHEN k=n THEN worst WHEN k>0 THEN gd ELSE ad END AS degradation, n AS n_methods, k AS n_methods_passed, ms AS val_methods, CASE WHEN k=n THEN 'CONFIRMED' WHEN k>0 THEN 'FRAGILE_EDGE' ELSE 'REJECT' END AS agreement, s1 AS sharpe_chan_is_oos, s2 AS sharpe_wfa_expanding FROM g"
)

_SMA200 = roll("avg", "ratio", 200)
_E20 = f"CASE WHEN count(*) OVER (PARTITION BY pair ORDER BY seq) >= 20 THEN pow(1-{_E21},seq::DOUBLE)*sum(ratio*CASE WHEN seq=1 THEN pow(1-{_E21},-1.0) ELSE {_E21}*pow(1-{_E21},-seq::DOUBLE) END) OVER (PARTITION BY pair ORDER BY seq) END"
_MORE_SIGNALS |= {
    "consec_down": lambda: _held_signal(
        f", a AS (SELECT *, ratio/nullif({lag('ratio')},0)-1 AS r, {_SMA200} AS sm FROM s), b AS (SELECT *, sum((NOT coalesce(r<0,false))::INTEGER) OVER (PARTITION BY pair ORDER BY seq) AS island FROM a), c AS (SELECT *, sum(coalesce(r<0,false)::INTEGER) OVER (PARTITION BY pair, island ORDER BY seq) AS streak FROM b)",
        "c", "streak>=3 AND ratio>sm", "r>0", 5),
    "rsi_connors": lambda: _held_signal(
        _D + f", c AS (SELECT *, greatest(dx,0) AS gn, greatest(-dx,0) AS ls, {roll('avg', 'ratio', 5)} AS s5, {_SMA200} AS sm FROM d), w AS (SELECT pair, seq, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l, 0.0::DOUBLE AS k FROM c WHERE seq=1 UNION ALL SELECT c.pair, c.seq, 0.75*w.g+gn, 0.75*w.l+ls, 0.75*w.k+1 FROM w JOIN c ON c.pair=w.pair AND c.seq=w.seq+1), "
        "y AS (SELECT c.*, CASE WHEN c.seq>=5 THEN 100-100/(1+(g/k)/nullif(l/k,0)) END AS rsi FROM c JOIN w ON w.pair=c.pair AND w.seq=c.seq)",
        "y", "rsi<=25 AND ratio>sm", "coalesce(ratio>s5,false) OR coalesce(rsi>=55,false)", 10),
    "vol_forecast_gate": lambda: _signal(
        f", a AS (SELECT *, ratio/{lag('ratio')}-1 AS r, (ratio-{_M20})/nullif({_SD20},0) AS z FROM s), b AS (SELECT *, {roll('stddev_samp', 'r', 20)} AS vol FROM a), c AS (SELECT *, 0.7*{ewm('vol', _E21, 1)}+0.3*CASE WHEN count(vol) OVER h >= 20 THEN avg(vol) OVER h END AS fc FROM b WINDOW h AS (PARTITION BY pair ORDER BY seq ROWS 251 PRECEDING)), "
        "dd AS (SELECT *, count(fc) OVER h AS cv, list(fc) FILTER (fc IS NOT NULL) OVER h AS held FROM c WINDOW h AS (PARTITION BY pair ORDER BY seq ROWS 251 PRECEDING)), "
        "ee AS (SELECT *, coalesce(CASE WHEN cv>=20 AND fc IS NOT NULL THEN (len(list_filter(held, lambda v: v<fc))+(len(list_filter(held, lambda v: v=fc))+1)/2.0)/len(held) END,0.5) AS pct FROM dd)", "ee", "z<=-2 AND pct<=0.30", "coalesce(z>=0,false) OR pct>=0.75"),
    "adx_ema_pullback": lambda: _signal(
        _ADX + f", pa AS (SELECT *, {_E20} AS e FROM aa), pb AS (SELECT *, coalesce((ratio<=e)::INTEGER,0) AS tch, coalesce((ratio>{lag('ratio')})::INTEGER,0) AS upb FROM pa), "
        f"pc AS (SELECT *, {lag('tch')} AS was, max(tch) OVER (PARTITION BY pair ORDER BY seq ROWS 4 PRECEDING) AS near, {lag('ratio')} AS prev, sum(upb) OVER (PARTITION BY pair ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS ups FROM pb)", "pc", "adx>25 AND ratio>e AND was=1 AND near=1", "ratio<prev AND ups=2"),
    "halflife_time_decay": lambda: (
        _REC + f", a AS (SELECT *, (ratio-{_M20})/nullif({_SD20},0) AS z FROM s), hs AS (SELECT pair, count(*)+1 AS n, regr_slope(dx,px) AS b FROM (SELECT pair, ratio-{lag('ratio')} AS dx, {lag('ratio')} AS px FROM s) WHERE px IS NOT NULL GROUP BY 1), hl AS (SELECT pair, CASE WHEN n>=30 AND b<0 THEN -ln(2)/b END AS hl FROM hs), "
        "g AS (SELECT a.*, coalesce(z<=-2,false) AS e0, coalesce(z>=0.5,false) AS x0, hl, floor(2*hl) AS most FROM a JOIN hl USING (pair)), "
        "m AS (SELECT pair, seq, CASE WHEN e0 THEN 0 ELSE -1 END AS held, false AS o FROM g WHERE seq=1 UNION ALL SELECT g.pair, g.seq, CASE WHEN m.held < 0 THEN CASE WHEN g.e0 THEN 0 ELSE -1 END WHEN coalesce(g.z,0) >= 0.5*greatest(1-(m.held+1)/g.most,0.1) OR m.held+1 >= g.most OR g.x0 THEN -1 ELSE m.held+1 END, "
        "m.held >= 0 AND (coalesce(g.z,0) >= 0.5*greatest(1-(m.held+1)/g.most,0.1) OR m.held+1 >= g.most OR g.x0) FROM m JOIN g ON g.pair=m.pair AND g.seq=m.seq+1), "
        f"f AS (SELECT g.pair, g.ts, g.seq, e0 AS e, CASE WHEN hl >= 2 THEN o ELSE x0 END AS x FROM g JOIN m ON m.pair=g.pair AND m.seq=g.seq) SELECT pair, ts, coalesce({lag('e')},false) AS entry, coalesce({lag('x')},false) AS \"exit\" FROM f"
    ),
}


def _johansen() -> str:
    """The same moments as sums, cleaned of the lagged differences, and the 2 x 2 problem's two roots."""
    names = ("da", "db", "la", "lb", "ea", "eb")
    col = lambda p, q: f"{p}_{q}" if names.index(p) <= names.index(q) else f"{q}_{p}"
    sums = ", ".join(f"sum({p}*{q}) AS {p}_{q}" for i, p in enumerate(names) for q in names[i:])
    clean = lambda p, q: f"{col(p, q)}-({col(p, 'ea')}*(eb_eb*{col(q, 'ea')}-ea_eb*{col(q, 'eb')})+{col(p, 'eb')}*(ea_ea*{col(q, 'eb')}-ea_eb*{col(q, 'ea')}))/(ea_ea*eb_eb-ea_eb*ea_eb)"
    four = names[:4]
    cleaned = ", ".join(f"{clean(p, q)} AS r_{p}_{q}" for i, p in enumerate(four) for q in four[i:])
    r = lambda p, q: f"r_{col(p, q)}"
    inv = {("da", "da"): "r_db_db/d0", ("db", "db"): "r_da_da/d0", ("da", "db"): "(-r_da_db/d0)", ("db", "da"): "(-r_da_db/d0)"}
    m = {(i, j): "(" + "+".join(f"{r(i, p)}*{inv[p, q]}*{r(j, q)}" for p in ("da", "db") for q in ("da", "db")) + ")" for i in ("la", "lb") for j in ("la", "lb")}
    return (
        S + ", j AS (SELECT pair, seq, lag(num_close) OVER w AS la, num_close-lag(num_close) OVER w AS da, lag(den_close) OVER w AS lb, den_close-lag(den_close) OVER w AS db FROM s WINDOW w AS (PARTITION BY pair ORDER BY seq)), "
        f"k AS (SELECT *, lag(da) OVER w AS ea, lag(db) OVER w AS eb FROM j WINDOW w AS (PARTITION BY pair ORDER BY seq)), g AS (SELECT pair, count(*) AS n, {sums} FROM k WHERE ea IS NOT NULL GROUP BY 1 HAVING count(*) >= 250), c AS (SELECT pair, n, {cleaned} FROM g), "
        "e AS (SELECT *, r_da_da*r_db_db-r_da_db*r_da_db AS d0, r_la_la*r_lb_lb-r_la_lb*r_la_lb AS d1 FROM c), "
        f"t AS (SELECT pair, n, (r_lb_lb*{m['la', 'la']}-r_la_lb*{m['lb', 'la']}-r_la_lb*{m['la', 'lb']}+r_la_la*{m['lb', 'lb']})/d1 AS t, ({m['la', 'la']}*{m['lb', 'lb']}-{m['la', 'lb']}*{m['lb', 'la']})/d1 AS d FROM e), "
        "x AS (SELECT pair, n, t/2+sqrt(greatest(t*t/4-d,0)) AS e1, t/2-sqrt(greatest(t*t/4-d,0)) AS e2 FROM t) SELECT pair, round(e1,6) AS eig_1, round(e2,6) AS eig_2, round(-n*(ln(1-e1)+ln(1-e2)),6) AS trace_stat, -n*(ln(1-e1)+ln(1-e2)) > 12.3212 AS passed FROM x"
    )


JOHANSEN = _johansen()
KDE = (
    RET + ", g AS (SELECT key, count(*) AS n, min(r) AS lo, max(r) AS hi, stddev_samp(r)*pow(count(*)::DOUBLE,-0.2) AS h FROM ret GROUP BY 1), p AS (SELECT *, lo+i*(hi-lo)/399 AS x FROM g, range(400) t(i)) "
    "SELECT p.key, i::INTEGER AS i, round(any_value(x),6) AS x, round(sum(exp(-pow((x-r)/h,2)/2)/sqrt(2*pi()))/any_value(n)/any_value(h),6) AS density FROM p JOIN ret ON ret.key=p.key GROUP BY 1,2"
)
