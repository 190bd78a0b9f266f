"""DuckDB SQL twins of the registered queries, built from shared common table expressions."""

from __future__ import annotations

import re

from .workload import CLASSES


def _money(x: str) -> str:
    rest = f"(abs({x}) % 100)"
    digits = f"CASE WHEN {rest} = 0 THEN '' WHEN {rest} % 10 = 0 THEN '.' || ({rest} // 10) ELSE '.' || lpad({rest}::VARCHAR, 2, '0') END"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || (abs({x}) // 100) || {digits})"


def _class(field: int) -> str:
    return "CASE " + " ".join(f"WHEN m BETWEEN {row[0]} AND {row[1]} THEN '{row[field]}'" for row in CLASSES) + " END"


def _id(prefix: str, suffix: str = "''") -> str:
    return f"printf('{prefix}%09d', k) || {suffix}"


_NORM = "regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g')"
_TOL = "greatest(abs({0}) * 0.02::DOUBLE, 50::DOUBLE)"
_SIM = (
    "CASE WHEN {x} = {y} THEN 1::DOUBLE WHEN {x} = '' OR {y} = '' THEN 0::DOUBLE"
    " ELSE 1::DOUBLE - levenshtein({x}, {y})::DOUBLE / greatest(length({x}), length({y})) END"
)


def _sim(a: str, b: str) -> str:
    return _SIM.format(x=_NORM.format(a), y=_NORM.format(b))


_AMOUNT = f"(CASE WHEN b_amount = net THEN 1::DOUBLE WHEN abs(b_amount - net) > {_TOL.format('b_amount')} THEN 0::DOUBLE ELSE 1::DOUBLE - abs(b_amount - net) / {_TOL.format('b_amount')} END)"
_DAYS = "abs(date_diff('day', settled_at, credited_at))"
_DATE = f"(CASE WHEN {_DAYS} = 0 THEN 1::DOUBLE WHEN {_DAYS} > 3 THEN 0::DOUBLE ELSE 1::DOUBLE - {_DAYS}::DOUBLE / 4 END)"
_REASON = (
    f"concat_ws('; ', CASE WHEN b_amount <> net THEN 'amount off by ' || {_money('abs(b_amount - net)')} END,"
    f" CASE WHEN {_DAYS} <> 0 THEN 'dates ' || {_DAYS} || ' day(s) apart' END,"
    " CASE WHEN similarity < 1 THEN 'reference similarity ' || round(similarity, 2)::VARCHAR END)"
)

CTE: dict[str, str] = {
    "b": """SELECT k, k % 100 AS m, k // 100 AS h, CAST(o_orderdate AS DATE) AS d, gross, fee, tax, gross - fee - tax AS net,
        'UTR' || printf('%06d', k + 1) || upper(left(md5(k::VARCHAR), 6)) AS utr, CASE WHEN (k // 100) % 2 = 0 THEN 1 ELSE -1 END AS sign
      FROM (SELECT *, (fee * 18 + 50) // 100 AS tax FROM (SELECT *, (gross * 2 + 50) // 100 AS fee FROM (
        SELECT o_orderkey::BIGINT AS k, o_orderdate, round(o_totalprice * 100)::BIGINT AS gross FROM orders)))""",
    "parts": """SELECT k, m, d, utr, n, price FROM b JOIN (
        SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n,
          round(l_extendedprice * 100)::BIGINT AS price FROM lineitem WHERE l_orderkey % 100 BETWEEN 85 AND 88) ON k = l_orderkey WHERE m BETWEEN 85 AND 88
      UNION ALL SELECT k, m, d, utr, n, price FROM b, (VALUES (1, 41300), (2, 68900), (3, 52700), (4, 57500)) v(n, price) WHERE m BETWEEN 89 AND 90""",
    "settlements": f"""SELECT {_id('setl_')} AS settlement_id, {_id('pay_')} AS payment_id, gross, fee, tax, CASE WHEN m BETWEEN 91 AND 93 THEN net + 1500 ELSE net END AS net,
        CASE WHEN m BETWEEN 44 AND 55 THEN d + (sign * (h % 3 + 1))::INTEGER WHEN m BETWEEN 78 AND 84 THEN d + 3 ELSE d END AS settled_at,
        CASE WHEN m BETWEEN 66 AND 71 THEN left(utr, 6) || '-' || substr(utr, 7) WHEN m BETWEEN 72 AND 77 THEN left(utr, 12)
          WHEN m BETWEEN 78 AND 84 THEN left(utr, 10) ELSE utr END AS utr, 'INR' AS currency, k * 100 AS seq
      FROM b WHERE m < 85 OR m BETWEEN 91 AND 95 OR m IN (97, 99)
      UNION ALL SELECT {_id('setl_', "'_d'")}, {_id('pay_', "'_d'")}, net * 1012 // 1000 + fee + tax, fee, tax, net * 1012 // 1000, d + 2, left(utr, 10), 'INR', k * 100 + 1
      FROM b WHERE m BETWEEN 82 AND 84
      UNION ALL SELECT {_id('setl_', "printf('_%02d', n)")}, {_id('pay_', "printf('_%02d', n)")}, price, 0, 0, price, d + ((n - 1) % 2)::INTEGER, utr || '_S' || n, 'INR', k * 100 + n
      FROM parts""",
    "payments": "SELECT 'ord_' || substr(payment_id, 5) AS order_id, payment_id, gross AS amount, currency, 'captured' AS status, settled_at AS created_at, seq FROM settlements",
    "credits": f"""SELECT {_id('bank_')} AS bank_credit_id, utr,
        CASE WHEN m BETWEEN 56 AND 65 THEN net + sign * (net * 8 // 1000) WHEN m = 98 THEN net * 1000 WHEN m BETWEEN 89 AND 90 THEN 110200 ELSE net END AS amount,
        CASE WHEN m = 98 THEN DATE '1990-06-15' WHEN m BETWEEN 89 AND 90 THEN d + 1 ELSE d END AS credited_at,
        CASE WHEN m = 97 THEN 'USD' ELSE 'INR' END AS currency, k * 100 AS seq FROM b WHERE m < 85 OR m IN (89, 90) OR m >= 96
      UNION ALL SELECT {_id('bank_', "'_x'")}, utr, net, d, 'INR', k * 100 + 1 FROM b WHERE m = 99
      UNION ALL SELECT {_id('bank_')}, utr, sum(price)::BIGINT, d + 1, 'INR', k * 100 FROM parts WHERE m <= 88 GROUP BY k, d, utr""",
    "bl": f"SELECT *, {_class(2)} AS class, {_class(3)} AS level FROM b",
    "labels": f"""SELECT {_id('bank_')} AS bank_credit_id, {_id('setl_')} AS settlement_id, NULL::VARCHAR[] AS settlement_ids, NULL AS decoy_settlement_id, 'match' AS label,
        NULL AS exception_type, CASE WHEN m = 99 THEN 'clean' ELSE class END AS class, level, k * 100 AS seq FROM bl WHERE m < 82 OR m = 99
      UNION ALL SELECT {_id('bank_')}, {_id('setl_')}, NULL, {_id('setl_', "'_d'")}, 'match', NULL, class, level, k * 100 FROM bl WHERE m BETWEEN 82 AND 84
      UNION ALL SELECT NULL, {_id('setl_', "'_d'")}, NULL, NULL, 'exception', class, class, level, k * 100 + 1 FROM bl WHERE m BETWEEN 82 AND 84
      UNION ALL SELECT {_id('bank_')}, ids[1], ids, NULL, 'match', NULL, CASE WHEN len(ids) > 1 THEN 'batched_payout' ELSE 'clean' END, 'clear', k * 100
        FROM (SELECT k, list({_id('setl_', "printf('_%02d', n)")} ORDER BY n) AS ids FROM parts WHERE m <= 88 GROUP BY k)
      UNION ALL SELECT {_id('bank_')}, NULL, NULL, NULL, 'exception', class, class, level, k * 100 FROM bl WHERE m IN (89, 90, 96, 97, 98)
      UNION ALL SELECT {_id('setl_', "printf('_%02d', n)")}.NULLIF(''), NULL, NULL, NULL, 'x', NULL, NULL, NULL, 0 FROM parts WHERE false
      UNION ALL SELECT NULL, {_id('setl_', "printf('_%02d', n)")}, NULL, NULL, 'exception', 'batched_payout_ambiguous', 'batched_payout_ambiguous', 'decoy', k * 100 + n FROM parts WHERE m >= 89
      UNION ALL SELECT NULL, {_id('setl_')}, NULL, NULL, 'exception', class, class, level, k * 100 + 1 FROM bl WHERE m BETWEEN 91 AND 95 OR m = 97
      UNION ALL SELECT {_id('bank_', "'_x'")}, NULL, NULL, NULL, 'exception', class, class, level, k * 100 + 1 FROM bl WHERE m = 99""",
    "log": f"""SELECT {_id('bank_')} AS record_id, 'bank' AS source, 'accept' AS decision, {_id('setl_')} AS corrected_match_id, 0.7::DOUBLE AS score, k AS seq FROM b WHERE m = 82
      UNION ALL SELECT {_id('bank_')}, 'bank', 'reject', NULL, NULL, k FROM b WHERE m = 98 AND h % 2 = 0""",
    "spoiled": """SELECT payment_id, CASE WHEN h4 = 1 THEN amount + 2 WHEN h4 = 3 THEN amount + 1 ELSE amount END AS amount, CASE WHEN h4 = 2 THEN 'USD' ELSE currency END AS currency, seq
      FROM (SELECT *, seq // 100 % 40 AS h4 FROM payments) WHERE h4 <> 0""",
}
CTE["labels"] = "\n".join(x for x in CTE["labels"].split("\n") if "NULLIF" not in x)


def _integrity(name: str, payments: str) -> None:
    fee = f"'net ' || {_money('net')} || ' is not gross less fee and tax, ' || {_money('(gross - fee - tax)')}"
    gross = f"'gross ' || {_money('gross')} || ' is not the paid amount, ' || {_money('paid')}"
    CTE[f"chk{name}"] = f"""SELECT s.*, p.amount AS paid, p.currency AS paid_currency, abs(gross - fee - tax - net) > 1 AS bad_fee_tax, p.payment_id IS NULL AS orphan,
        coalesce(abs(gross - p.amount) > 1, false) AS bad_gross, coalesce(s.currency <> p.currency, false) AS bad_currency
      FROM settlements s LEFT JOIN {payments} p USING (payment_id)"""
    CTE[f"flagged{name}"] = f"""SELECT settlement_id AS record_id, 'settlement' AS source,
        CASE WHEN bad_fee_tax THEN {fee} WHEN orphan THEN 'no payment ' || payment_id WHEN bad_gross THEN {gross} ELSE 'settled in ' || currency || ', paid in ' || paid_currency END AS reason,
        CASE WHEN bad_fee_tax THEN 'fee_tax_mismatch' WHEN NOT orphan AND NOT bad_gross THEN 'currency_mismatch' END AS exception_type, 1 AS precedence, seq
      FROM chk{name} WHERE bad_fee_tax OR orphan OR bad_gross OR bad_currency"""


_integrity("", "payments")
_integrity("_spoiled", "spoiled")
CTE["clean"] = "SELECT * FROM settlements WHERE settlement_id NOT IN (SELECT record_id FROM flagged)"
CTE["human"] = """SELECT CASE WHEN source = 'bank' THEN record_id ELSE corrected_match_id END AS bank_credit_id, CASE WHEN source = 'bank' THEN corrected_match_id ELSE record_id END AS settlement_id,
    NULL::VARCHAR[] AS components, 1::DOUBLE AS confidence, 'human' AS matched_by, 'accepted in review' AS reasoning FROM log WHERE decision = 'accept'"""
CTE["bank1"] = "SELECT * FROM credits WHERE bank_credit_id NOT IN (SELECT bank_credit_id FROM human UNION ALL SELECT record_id FROM log WHERE decision = 'reject')"
CTE["setl1"] = "SELECT * FROM clean WHERE settlement_id NOT IN (SELECT settlement_id FROM human)"


def _passes(n: str, bank: str, settlement: str) -> None:
    """The passes of a run over two pools; n: suffix of its tables."""
    key = "utr, amount, currency, day"
    CTE[f"exact{n}"] = f"""SELECT bank_credit_id, settlement_id, NULL::VARCHAR[] AS components, 1::DOUBLE AS confidence, 'exact' AS matched_by, NULL AS reasoning FROM
        (SELECT bank_credit_id, utr, amount, currency, credited_at AS day, row_number() OVER (PARTITION BY utr, amount, currency, credited_at ORDER BY seq) AS rn FROM {bank})
        JOIN (SELECT settlement_id, utr, net AS amount, currency, settled_at AS day, row_number() OVER (PARTITION BY utr, net, currency, settled_at ORDER BY seq) AS rn FROM {settlement})
        USING ({key}, rn)"""
    CTE[f"xb{n}"] = f"SELECT * FROM {bank} WHERE bank_credit_id NOT IN (SELECT bank_credit_id FROM exact{n})"
    CTE[f"xs{n}"] = f"SELECT * FROM {settlement} WHERE settlement_id NOT IN (SELECT settlement_id FROM exact{n})"
    CTE[f"near{n}"] = f"""SELECT bank_credit_id, settlement_id, c.utr AS b_utr, s.utr AS s_utr, amount AS b_amount, net, credited_at, settled_at, c.seq AS b_seq, s.seq AS s_seq,
        {_sim('c.utr', 's.utr')} AS similarity
      FROM xb{n} c JOIN xs{n} s ON c.currency = s.currency AND s.settled_at BETWEEN c.credited_at - 3 AND c.credited_at + 3 AND abs(amount - net) < {_TOL.format('amount')}"""
    CTE[f"cand{n}"] = f"""SELECT bank_credit_id, settlement_id, b_seq, s_seq, similarity, {_AMOUNT} * 0.4::DOUBLE + {_DATE} * 0.3::DOUBLE + similarity * 0.3::DOUBLE AS score, {_REASON} AS reasoning
      FROM near{n} WHERE similarity >= 0.65::DOUBLE"""
    CTE[f"e0{n}"] = f"SELECT * FROM cand{n} WHERE score >= 0.5::DOUBLE"
    for r in range(3):
        CTE[f"w{r}{n}"] = f"""SELECT * EXCLUDE (rb, rs) FROM (SELECT *, row_number() OVER (PARTITION BY bank_credit_id ORDER BY score DESC, b_seq, s_seq) AS rb,
            row_number() OVER (PARTITION BY settlement_id ORDER BY score DESC, b_seq, s_seq) AS rs FROM e{r}{n}) WHERE rb = 1 AND rs = 1"""
        CTE[f"e{r + 1}{n}"] = f"""SELECT * FROM e{r}{n} WHERE bank_credit_id NOT IN (SELECT bank_credit_id FROM w{r}{n}) AND settlement_id NOT IN (SELECT settlement_id FROM w{r}{n})"""
    CTE[f"assigned{n}"] = f"SELECT * FROM w0{n} UNION ALL SELECT * FROM w1{n} UNION ALL SELECT * FROM w2{n}"
    CTE[f"fuzzy{n}"] = f"""SELECT bank_credit_id, settlement_id, NULL::VARCHAR[] AS components, round(score, 4) AS confidence, 'fuzzy' AS matched_by, reasoning FROM assigned{n} WHERE score >= 0.75::DOUBLE"""
    CTE[f"amb{n}"] = f"SELECT bank_credit_id, settlement_id, round(score, 4) AS score, reasoning, b_seq, s_seq FROM assigned{n} WHERE score < 0.75::DOUBLE"
    meet = f"xb{n} c JOIN xs{n} s ON c.utr = s.utr AND c.amount = s.net AND c.credited_at = s.settled_at AND c.currency <> s.currency"
    CTE[f"cur{n}"] = f"""SELECT record_id, source, 'same reference, amount and day in another currency' AS reason, 'currency_mismatch' AS exception_type, 2 AS precedence, seq FROM (
        SELECT DISTINCT bank_credit_id AS record_id, 'bank' AS source, c.seq AS seq FROM {meet} UNION ALL SELECT DISTINCT settlement_id, 'settlement', s.seq FROM {meet})
      WHERE record_id NOT IN (SELECT bank_credit_id FROM assigned{n}) AND record_id NOT IN (SELECT settlement_id FROM assigned{n})"""
    CTE[f"fb{n}"] = f"SELECT * FROM xb{n} WHERE bank_credit_id NOT IN (SELECT bank_credit_id FROM assigned{n}) AND bank_credit_id NOT IN (SELECT record_id FROM cur{n})"
    CTE[f"fs{n}"] = f"SELECT * FROM xs{n} WHERE settlement_id NOT IN (SELECT settlement_id FROM assigned{n}) AND settlement_id NOT IN (SELECT record_id FROM cur{n})"
    CTE[f"link{n}"] = f"""SELECT bank_credit_id, settlement_id, amount, net, b_seq, s_seq, n_linked FROM (
        SELECT bank_credit_id, settlement_id, amount, net, c.seq AS b_seq, s.seq AS s_seq, count(*) OVER (PARTITION BY bank_credit_id) AS n_linked
        FROM fb{n} c JOIN fs{n} s ON contains(s.utr, '_S') AND c.utr = split_part(s.utr, '_S', 1) AND c.currency = s.currency AND s.settled_at BETWEEN c.credited_at - 5 AND c.credited_at + 5) WHERE n_linked >= 2"""
    CTE[f"pool{n}"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bank_credit_id ORDER BY s_seq) AS place FROM link{n}) WHERE place <= 25"
    CTE[f"sub{n}"] = f"""SELECT bank_credit_id, b_seq, amount, [place] AS path, [settlement_id] AS names, net AS total, place AS last FROM pool{n}
      UNION ALL SELECT r.bank_credit_id, r.b_seq, r.amount, list_append(path, p.place), list_append(names, p.settlement_id), total + p.net, p.place
      FROM sub{n} r JOIN pool{n} p ON r.bank_credit_id = p.bank_credit_id AND p.place > r.last WHERE len(path) < 6"""
    CTE[f"hit{n}"] = f"""SELECT *, row_number() OVER (PARTITION BY bank_credit_id ORDER BY path) AS nth FROM sub{n} WHERE len(path) >= 2 AND abs(total - amount) <= greatest(abs(amount) * 0.02::DOUBLE, 50) + 1e-9"""
    CTE[f"solved{n}"] = f"""SELECT t.bank_credit_id, t.b_seq, t.amount, coalesce(q.n, 0)::INTEGER AS n_solutions, q.components, coalesce(q.listed, '') AS listed FROM (SELECT DISTINCT bank_credit_id, b_seq, amount FROM link{n}) t
      LEFT JOIN (SELECT bank_credit_id, count(*) AS n, arg_min(names, nth) AS components, string_agg(array_to_string(list_sort(names), '+'), ' | ' ORDER BY nth) AS listed FROM hit{n} WHERE nth <= 5 GROUP BY 1) q USING (bank_credit_id)"""
    CTE[f"split{n}"] = f"""SELECT bank_credit_id, components[1] AS settlement_id, components, 1::DOUBLE AS confidence, 'split' AS matched_by,
        len(components) || ' settlements make up ' || {_money('amount')} AS reasoning FROM solved{n} WHERE n_solutions = 1"""
    CTE[f"splitx{n}"] = f"""SELECT bank_credit_id AS record_id, 'bank' AS source, 'several sets of settlements fit: ' || listed AS reason, 'batched_payout' AS exception_type, 3 AS precedence, b_seq AS seq FROM solved{n} WHERE n_solutions > 1"""
    CTE[f"pb{n}"] = f"SELECT * FROM fb{n} WHERE bank_credit_id NOT IN (SELECT bank_credit_id FROM split{n})"
    CTE[f"ps{n}"] = f"SELECT * FROM fs{n} WHERE settlement_id NOT IN (SELECT unnest(components) FROM split{n})"
    CTE[f"reply{n}"] = f"""SELECT bank_credit_id, settlement_id, CASE h % 4 WHEN 0 THEN 'Sure: {{"verdict": "match", "reasoning": " same payer "}}' WHEN 1 THEN '{{"verdict": "no_match", "reasoning": "other payer"}}'
        WHEN 2 THEN '{{"verdict": "unsure"}}' ELSE 'no idea' END AS reply FROM (SELECT *, substr(bank_credit_id, 6, 9)::BIGINT // 100 AS h FROM amb{n})"""
    CTE[f"body{n}"] = f"SELECT *, regexp_extract(reply, '(?s)\\{{.*\\}}') AS body FROM reply{n}"
    CTE[f"said{n}"] = f"""SELECT bank_credit_id, settlement_id, CASE WHEN body <> '' AND json_valid(body) AND coalesce(v IN ('match', 'no_match', 'unsure'), false) THEN v ELSE 'unsure' END AS verdict,
        CASE WHEN body = '' THEN 'reply holds no JSON' WHEN NOT json_valid(body) THEN 'reply holds invalid JSON' WHEN NOT coalesce(v IN ('match', 'no_match', 'unsure'), false) THEN 'reply holds no known verdict'
          WHEN trim(coalesce(w, '')) = '' THEN 'no reason given' ELSE trim(w) END AS said
      FROM (SELECT *, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.verdict') END AS v, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.reasoning') END AS w FROM body{n})"""
    CTE[f"llm{n}"] = f"""SELECT bank_credit_id, settlement_id, NULL::VARCHAR[] AS components, greatest(score, 0.8::DOUBLE) AS confidence, 'llm' AS matched_by, said AS reasoning FROM amb{n} JOIN said{n} USING (bank_credit_id, settlement_id) WHERE verdict = 'match'"""
    sides = "SELECT {0} AS reason, bank_credit_id AS record_id, 'bank' AS source, b_seq AS seq FROM {1} UNION ALL SELECT {0}, settlement_id, 'settlement', s_seq FROM {1}"
    shape = "SELECT record_id, source, reason, NULL AS exception_type, 4 AS precedence, seq FROM ({0})"
    CTE[f"llmx{n}"] = shape.format(sides.format("'verdict ' || verdict || ': ' || said", f"(SELECT * FROM amb{n} JOIN said{n} USING (bank_credit_id, settlement_id) WHERE verdict <> 'match')"))
    CTE[f"nollmx{n}"] = shape.format(sides.format("'ambiguous, no verdict source'", f"amb{n}"))


_passes("", "credits", "clean")
_passes("_h", "bank1", "setl1")


def _turns(rounds: int) -> None:
    """Batched payouts from any settlement of the window: rounds in which what was taken changes the pools of later credits."""
    tolerance = "greatest(abs({0}) * 0.02::DOUBLE, 50) + 1e-9"
    CTE["wide"] = """SELECT bank_credit_id, settlement_id, amount, net, c.seq AS b_seq, s.seq AS s_seq, contains(s.utr, '_S') AND c.utr = split_part(s.utr, '_S', 1) AS linked
      FROM fb c JOIN fs s ON c.currency = s.currency AND s.settled_at BETWEEN c.credited_at - 5 AND c.credited_at + 5"""
    CTE["taken_0"] = "SELECT NULL::VARCHAR AS settlement_id, NULL::BIGINT AS taken_at WHERE false"
    CTE["turn_0"] = "SELECT NULL::VARCHAR AS bank_credit_id, NULL::BIGINT AS b_seq, NULL::BIGINT AS amount, NULL::VARCHAR AS pool, 0 AS n_solutions, NULL::VARCHAR[] AS components, NULL::VARCHAR AS listed WHERE false"
    for r in range(1, rounds + 1):
        CTE[f"seen_{r}"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bank_credit_id ORDER BY s_seq) AS place, count(*) OVER (PARTITION BY bank_credit_id) AS n FROM (
            SELECT *, sum(linked::INTEGER) OVER (PARTITION BY bank_credit_id) AS n_linked FROM wide LEFT JOIN taken_{r - 1} USING (settlement_id) WHERE taken_at IS NULL OR taken_at >= b_seq)
          WHERE linked OR n_linked < 2) WHERE place <= 25 AND n >= 2"""
        CTE[f"keyed_{r}"] = f"SELECT bank_credit_id, b_seq, amount, string_agg(settlement_id, ',' ORDER BY place) AS pool FROM seen_{r} GROUP BY 1, 2, 3"
        CTE[f"stale_{r}"] = f"SELECT k.* FROM keyed_{r} k LEFT JOIN turn_{r - 1} t USING (bank_credit_id) WHERE t.pool IS DISTINCT FROM k.pool"
        CTE[f"again_{r}"] = f"SELECT * FROM seen_{r} WHERE bank_credit_id IN (SELECT bank_credit_id FROM stale_{r})"
        CTE[f"sums_{r}"] = f"""SELECT bank_credit_id, amount, [place] AS path, net AS total, place AS last FROM again_{r}
          UNION ALL SELECT x.bank_credit_id, x.amount, list_append(path, p.place), total + p.net, p.place
          FROM sums_{r} x JOIN again_{r} p ON x.bank_credit_id = p.bank_credit_id AND p.place > x.last WHERE len(path) < 6 AND total + p.net <= x.amount + {tolerance.format('x.amount')}"""
        CTE[f"fits_{r}"] = f"""SELECT *, row_number() OVER (PARTITION BY bank_credit_id ORDER BY path) AS nth FROM sums_{r} WHERE len(path) >= 2 AND abs(total - amount) <= {tolerance.format('amount')}"""
        CTE[f"sets_{r}"] = f"""SELECT bank_credit_id, nth, list(settlement_id ORDER BY place) AS names FROM (SELECT bank_credit_id, nth, unnest(path) AS place FROM fits_{r} WHERE nth <= 5) JOIN again_{r} USING (bank_credit_id, place) GROUP BY 1, 2"""
        CTE[f"turn_{r}"] = f"""SELECT s.bank_credit_id, s.b_seq, s.amount, s.pool, coalesce(q.n, 0)::INTEGER AS n_solutions, q.components, coalesce(q.listed, '') AS listed FROM stale_{r} s LEFT JOIN (
            SELECT bank_credit_id, count(*) AS n, arg_min(names, nth) AS components, string_agg(array_to_string(list_sort(names), '+'), ' | ' ORDER BY nth) AS listed FROM sets_{r} GROUP BY 1) q USING (bank_credit_id)
          UNION ALL SELECT t.* FROM turn_{r - 1} t JOIN keyed_{r} k USING (bank_credit_id) WHERE t.pool = k.pool"""
        CTE[f"taken_{r}"] = f"SELECT settlement_id, min(b_seq) AS taken_at FROM (SELECT unnest(components) AS settlement_id, b_seq FROM turn_{r} WHERE n_solutions = 1) GROUP BY 1"


TURNS = 6
_turns(TURNS)


def _left(n: str, bank: str, settlement: str) -> None:
    CTE[f"leftb{n}"] = f"""SELECT bank_credit_id AS record_id, 'bank' AS source,
        CASE WHEN linked THEN 'linked settlements do not make up the credit' WHEN plausible THEN 'no settlement is left for this credit' ELSE 'nothing near this credit' END AS reason,
        CASE WHEN linked THEN 'batched_payout' WHEN plausible THEN 'unclaimed_bank_credit' ELSE 'unresolvable_noise' END AS exception_type, 5 AS precedence, seq
      FROM (SELECT c.*, c.utr IN (SELECT split_part(utr, '_S', 1) FROM settlements WHERE contains(utr, '_S')) AS linked,
        bank_credit_id IN (SELECT bank_credit_id FROM {bank} x JOIN settlements s ON x.currency = s.currency AND s.settled_at BETWEEN x.credited_at - 3 AND x.credited_at + 3
          AND abs(x.amount - s.net) <= {_TOL.format('x.amount')}) AS plausible FROM {bank} c)"""
    CTE[f"lefts{n}"] = f"""SELECT settlement_id AS record_id, 'settlement' AS source, 'no credit came for this settlement' AS reason, 'settlement_pending_bank' AS exception_type, 6 AS precedence, seq FROM {settlement}"""


_COLS = "record_id, source, reason, exception_type, precedence, seq"


def _run(n: str, p: str, verdicts: bool, log: bool) -> None:
    """Matches and exceptions of a whole run; n: its suffix, p: that of its passes."""
    _left(n, f"pb{p}", f"ps{p}")
    names = (["human"] if log else []) + [f"exact{p}", f"fuzzy{p}", f"split{p}"] + ([f"llm{p}"] if verdicts else [])
    order = {"human": 1, "exact": 2, "fuzzy": 3, "split": 4, "llm": 5}
    CTE[f"matches{n}"] = " UNION ALL ".join(f"SELECT *, {order[x.removesuffix(p) if p else x]} AS pass_order FROM {x}" for x in names)
    CTE[f"ids{n}"] = f"SELECT 'bank' AS source, bank_credit_id AS record_id FROM matches{n} UNION SELECT 'settlement', settlement_id FROM matches{n} UNION SELECT 'settlement', unnest(components) FROM matches{n}"
    CTE[f"rejects{n}"] = "SELECT record_id, source, 'rejected for good in review' AS reason, NULL AS exception_type, 7 AS precedence, seq FROM log WHERE decision = 'reject'"
    rows = ["flagged", f"cur{p}", f"splitx{p}", f"llmx{p}" if verdicts else f"nollmx{p}", f"leftb{n}", f"lefts{n}"] + ([f"rejects{n}"] if log else [])
    union = " UNION ALL ".join(f"SELECT {_COLS} FROM {x}" for x in rows)
    CTE[f"exc{n}"] = f"""SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY source, record_id ORDER BY precedence, seq) AS rn FROM ({union})
        WHERE (source, record_id) NOT IN (SELECT (source, record_id) FROM ids{n})) WHERE rn = 1"""


_run("_0", "", False, False)  # no verdicts, no corrections
_run("_v", "", True, False)  # verdicts
_run("_a", "_h", True, True)  # verdicts and corrections


def _scores(n: str) -> None:
    key_m = "array_to_string(list_sort(coalesce(components, [settlement_id])), '+')"
    CTE[f"want{n}"] = "SELECT *, coalesce(len(settlement_ids), 0) > 1 AS many, CASE WHEN coalesce(len(settlement_ids), 0) > 1 THEN array_to_string(list_sort(settlement_ids), '+') ELSE settlement_id END AS key FROM labels WHERE label = 'match'"
    parts = []
    for many, key in (("many", key_m), ("NOT many", "settlement_id")):
        parts.append(f"""SELECT a.bank_credit_id, a.settlement_id, a.matched_by, b.class AS label_class, b.level FROM
          (SELECT *, {key} AS key, row_number() OVER (PARTITION BY bank_credit_id, {key} ORDER BY pass_order) AS rn FROM matches{n}) a
          JOIN (SELECT *, row_number() OVER (PARTITION BY bank_credit_id, key ORDER BY seq) AS rn FROM want{n} WHERE {many}) b ON a.bank_credit_id = b.bank_credit_id AND a.key = b.key AND a.rn = b.rn""")
    CTE[f"tp{n}"] = " UNION ALL ".join(parts)
    CTE[f"cnt{n}"] = f"""SELECT tp, p - tp AS fp, t - tp AS fn, p AS n_predicted, t AS n_true FROM (SELECT (SELECT count(*) FROM tp{n}) AS tp, (SELECT count(*) FROM matches{n}) AS p, (SELECT count(*) FROM want{n}) AS t)"""
    CTE[f"head{n}"] = f"""SELECT CASE WHEN n_predicted = 0 THEN 1::DOUBLE ELSE round(tp::DOUBLE / n_predicted, 6) END AS precision, CASE WHEN n_true = 0 THEN 1::DOUBLE ELSE round(tp::DOUBLE / n_true, 6) END AS recall,
        CASE WHEN n_true = 0 THEN 1::DOUBLE ELSE round(tp::DOUBLE / n_true, 6) END AS match_rate, CASE WHEN n_predicted = 0 THEN 0::DOUBLE ELSE round(fp::DOUBLE / n_predicted, 6) END AS fp_rate FROM cnt{n}"""


for _n in ("_0", "_v", "_a"):
    _scores(_n)
CTE["mm_0"] = "SELECT *, row_number() OVER () AS mid FROM matches_0"
CTE["flat_0"] = "SELECT mid, bank_credit_id, settlement_id FROM mm_0 UNION SELECT mid, bank_credit_id, unnest(components) FROM mm_0"
CTE["member_0"] = """SELECT mid, level FROM flat_0 JOIN labels l USING (bank_credit_id) UNION SELECT mid, level FROM flat_0 f JOIN labels l ON f.settlement_id = coalesce(l.settlement_id, l.settlement_ids[1])"""
CTE["lvl_0"] = """SELECT v.level, coalesce(tp, 0) AS tp, coalesce(p, 0) - coalesce(tp, 0) AS fp, coalesce(t, 0) - coalesce(tp, 0) AS fn, coalesce(p, 0) AS n_predicted, coalesce(t, 0) AS n_true
  FROM (VALUES ('clear'), ('boundary'), ('decoy'), ('unresolvable')) v(level)
  LEFT JOIN (SELECT level, count(*) AS tp FROM tp_0 GROUP BY 1) USING (level)
  LEFT JOIN (SELECT level, count(*) AS p FROM member_0 GROUP BY 1) USING (level) LEFT JOIN (SELECT level, count(*) AS t FROM want_0 GROUP BY 1) USING (level)"""
CTE["defer_0"] = """SELECT level, count(*) AS n, count(*) FILTER (NOT wrong) AS deferred, round(count(*) FILTER (NOT wrong)::DOUBLE / count(*), 6) AS rate FROM (
  SELECT level, CASE WHEN class = 'near_duplicate_decoy' THEN s ELSE s OR b END AS wrong FROM (
    SELECT *, coalesce(bank_credit_id IN (SELECT bank_credit_id FROM flat_0), false) AS b, coalesce(settlement_id IN (SELECT settlement_id FROM flat_0), false) AS s
    FROM labels WHERE label = 'exception' AND level IN ('decoy', 'unresolvable'))
  UNION ALL SELECT level, coalesce((bank_credit_id, decoy_settlement_id) IN (SELECT (bank_credit_id, settlement_id) FROM flat_0), false) FROM labels
    WHERE label = 'match' AND decoy_settlement_id IS NOT NULL AND level IN ('decoy', 'unresolvable')) GROUP BY level"""
CTE["true_ids"] = """SELECT 'bank' AS source, bank_credit_id AS record_id FROM labels WHERE label = 'exception' AND bank_credit_id IS NOT NULL
  UNION SELECT 'settlement', settlement_id FROM labels WHERE label = 'exception' AND settlement_id IS NOT NULL"""
CTE["src_0"] = """SELECT matched_by, coalesce(n, 0) AS n FROM (VALUES ('human'), ('exact'), ('fuzzy'), ('split'), ('llm')) v(matched_by) LEFT JOIN (SELECT matched_by, count(*) AS n FROM matches_0 GROUP BY 1) USING (matched_by)"""
CTE["cp"] = "SELECT record_id, source, reason, seq, regexp_replace(record_id, '[^0-9]', '', 'g') AS digits FROM exc_0 WHERE source IN ('bank', 'settlement')"
CTE["counterpart"] = """SELECT a.record_id, a.source, a.seq, coalesce(
    (SELECT arg_min(record_id, (seq, record_id)) FROM cp b WHERE b.reason = a.reason AND b.digits = a.digits AND b.source <> a.source), f.first) AS counterpart_id
  FROM cp a LEFT JOIN (SELECT reason, source, arg_min(record_id, (seq, record_id)) AS first FROM cp GROUP BY 1, 2) f ON f.reason = a.reason AND f.source <> a.source"""
BATCHES = 5
for _i in range(BATCHES):
    CTE[f"bankq_{_i}"] = f"SELECT * FROM credits WHERE substr(bank_credit_id, 6, 9)::BIGINT // 100 % {BATCHES} = {_i}"
    CTE[f"setlq_{_i}"] = f"SELECT * FROM clean WHERE substr(settlement_id, 6, 9)::BIGINT // 100 % {BATCHES} = {_i}"
    _passes(f"_q{_i}", f"bankq_{_i}", f"setlq_{_i}")
CTE["matches_q"] = " UNION ALL ".join(f"SELECT *, {o} AS pass_order, {i} AS batch_id FROM {name}_q{i}" for i in range(BATCHES) for o, name in ((2, "exact"), (3, "fuzzy"), (4, "split")))
_scores("_q")
CTE["per_batch"] = f"""SELECT v.batch_id, coalesce(tp, 0) AS tp, coalesce(p, 0) AS p, coalesce(t, 0) AS t FROM (SELECT DISTINCT batch_id FROM matches_q) v
  LEFT JOIN (SELECT substr(bank_credit_id, 6, 9)::BIGINT // 100 % {BATCHES} AS batch_id, count(*) AS tp FROM tp_q GROUP BY 1) USING (batch_id)
  LEFT JOIN (SELECT batch_id, count(*) AS p FROM matches_q GROUP BY 1) USING (batch_id)
  LEFT JOIN (SELECT substr(bank_credit_id, 6, 9)::BIGINT // 100 % {BATCHES} AS batch_id, count(*) AS t FROM want_q GROUP BY 1) USING (batch_id)"""
CTE["batch_head"] = """SELECT batch_id, round(tp::DOUBLE / p, 6) AS precision, round(tp::DOUBLE / t, 6) AS recall, round(tp::DOUBLE / t, 6) AS match_rate, round((p - tp)::DOUBLE / p, 6) AS fp_rate FROM per_batch"""

#: tables that later ones read more than once
_HEAVY = re.compile(r"^(b|parts|settlements|credits|labels|flagged|exact|xb|xs|cand|e[0-3]|w[0-2]|assigned|cur|link|pool|hit|solved|amb|said|matches|exc|flat|tp|cp|wide|taken|turn|seen|keyed|stale|again|fits|sets)(_\w+)?$")


def select(body: str) -> str:
    """A statement with the table expressions that ``body`` needs."""
    needed: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z]\w*\b", text)):
            if word in CTE and word != own and word not in needed:
                visit(CTE[word], word)
                if word not in needed:
                    needed.append(word)

    visit(body)
    names = [f"{n} AS {'MATERIALIZED ' if _HEAVY.match(n) else ''}({CTE[n]})" for n in needed]
    return ("WITH RECURSIVE " + ",\n".join(names) + "\n" if names else "") + body
