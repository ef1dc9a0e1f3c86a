"""The same answers in SQL (DuckDB dialect), written independently of the Spark operators.

Each oracle is one statement: the derived tables it needs, then its own query.
"""

from __future__ import annotations

import re

from casework.plans.fixtures import FAULTS, fault_cases
from casework.schemas import DOCUMENT_SOURCE

_SPACES = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
_WS = "(" + " || ".join(f"chr({c})" for c in _SPACES) + ")"
_WS_CLASS = "[" + "".join(rf"\x{{{c:X}}}" for c in _SPACES) + "]+"


def _trim(x: str) -> str:
    return f"trim({x}, {_WS})"


def _match(x: str) -> str:
    return _trim(f"regexp_replace(lower({x}), '{_WS_CLASS}', ' ', 'g')")


def _time(x: str) -> str:
    return (
        f"(try_strptime(CASE WHEN regexp_matches({_trim(x)}, '^\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{1,2}}:\\d{{2}}$')"
        f" THEN {_trim(x)} END, '%Y-%m-%d %H:%M') - INTERVAL 330 MINUTE)"
    )


def _bad_time(x: str) -> str:
    return f"({_trim(f'coalesce({x}, chr(32))')} <> '' AND {_time(x)} IS NULL)"


def _bool(x: str) -> str:
    return (f"CASE WHEN {x} IN ('1','t','T','TRUE','true','True') THEN true "
            f"WHEN {x} IN ('0','f','F','FALSE','false','False') THEN false END")


def _stored(x: str) -> str:
    """Two decimals, half up on the shortest decimal form."""
    return f"try_cast(cast({x} AS varchar) AS decimal(12,2))"


def _ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


_NUMBER = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"


def _fee(x: str) -> str:
    return f"try_cast(CASE WHEN regexp_matches({x}, {_NUMBER}) THEN {x} END AS double)"


_CTES: dict[str, str] = {
    "accounts": """SELECT 'ACCT-' || c_custkey AS account_id, c_name AS account_name,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'Enterprise' WHEN 'AUTOMOBILE' THEN 'Growth'
          ELSE 'Standard' END AS plan,
        CASE WHEN c_acctbal < 0 THEN 'Suspended' ELSE 'Active' END AS status,
        c_acctbal > 8000 AS premium_support FROM customer""",
    "shipments": f"""SELECT 'ORD-' || o_orderkey AS order_id, 'ACCT-' || o_custkey AS account_id,
        o_orderpriority AS carrier,
        CASE WHEN o_orderstatus = 'O' THEN if(o_orderkey % 6 = 5, 'DRAFT', 'BOOKED')
          WHEN o_orderstatus = 'P' THEN if(o_orderkey % 5 = 0, 'RETURN_TO_ORIGIN', 'PICKED_UP')
          ELSE if(o_orderkey % 5 = 0, 'CANCELLED', 'DELIVERED') END AS status,
        {_stored('o_totalprice / 50')} AS shipment_fee_inr,
        o_orderkey % 3 <> 0 AS carrier_fault, o_orderkey % 7 = 0 AS customer_fault,
        o_orderdate AS booked_at,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + to_hours(o_orderkey % 5) END
          AS pickup_window_end, o_orderkey AS k
        FROM orders""",
    "tickets": """SELECT 'TCK-' || event_id AS ticket_id, 'ACCT-' || user_id AS account_id,
        ts AS created_at, if(event_id % 3 = 0, 'closed', 'open') AS status,
        CASE WHEN event_id % 20 = 0 THEN 'Possible API key exposure'
          WHEN event_id % 10 = 0 THEN 'POSSIBLE api KEY exposure' ELSE 'Pickup delayed' END AS subject,
        event_type AS description, event_id AS k FROM events WHERE event_type = 'error'""",
    "requests": """SELECT event_id AS request_id,
        if(event_id % 101 = 0, '', 'Please cancel ORD-' || event_id) AS query,
        CASE WHEN event_id % 97 = 0 THEN 'ACCT-NONE' WHEN event_id % 50 = 0 THEN 'ACCT-' || user_id
          ELSE 'ACCT-' || o_custkey END AS account_id,
        CASE WHEN event_id % 53 = 0 THEN '' WHEN event_id % 89 = 0 THEN 'ORD-NONE'
          ELSE 'ORD-' || event_id END AS order_id,
        o_orderdate + to_hours((event_id * 13) % 12) AS requested_at, event_type AS channel
        FROM events JOIN orders ON o_orderkey = event_id""",
    "policy_docs": """SELECT 'ACCT-' || c_custkey AS account_id, c_custkey * 10 + slot AS document_id, content
        FROM (
          SELECT c_custkey, 1 AS slot, c_name || '  may cancel any BOOKED shipment before pickup'
            || chr(10) || 'with no cancellation fee.' AS content FROM customer WHERE c_custkey % 3 = 0
          UNION ALL SELECT c_custkey, 2, c_name || ' cannot cancel shipments on public holidays.'
            FROM customer WHERE c_custkey % 15 = 0
          UNION ALL SELECT c_custkey, 3, c_name || ' receives a fixed INR 300 service credit if a pickup'
            || ' is more than 4 hours past the end of the window and the carrier is at fault.'
            FROM customer WHERE c_custkey % 4 = 0)""",
    "evidence": """SELECT request_id, document_id, content,
          ((request_id * 37 + document_id) % 60 + 40) / 100.0::DOUBLE AS score
        FROM requests JOIN policy_docs USING (account_id)
        UNION ALL SELECT request_id, 0, 'An order that is BOOKED, not yet PICKED_UP may be cancelled.', 0.5
        FROM requests WHERE channel <> 'click'""",
    "flags": f"""SELECT request_id, document_id, score,
          contains(t, n) AND contains(t, 'may cancel any booked shipment') AND contains(t, 'before pickup')
            AND contains(t, 'no cancellation fee') AS is_agreement,
          contains(t, n) AND (contains(t, 'cannot cancel') OR contains(t, 'may not cancel')
            OR contains(t, 'cancellation is not permitted')) AS is_deny,
          contains(t, 'booked, not yet picked_up') AND contains(t, 'may be cancelled') AS is_policy,
          contains(t, n) AND contains(t, 'fixed inr 300 service credit')
            AND contains(t, 'more than 4 hours past the end') AND contains(t, 'carrier is at fault')
            AS is_credit_override
        FROM (SELECT e.request_id, e.document_id, e.score, {_match('e.content')} AS t, lower(a.account_name) AS n
          FROM evidence e JOIN requests r USING (request_id) JOIN accounts a USING (account_id))""",
    "summary": """SELECT r.request_id, greatest(0.0, coalesce(max(score), 0.0)) AS best_score,
          count(*) FILTER (is_agreement) AS agreement_count, count(*) FILTER (is_deny) AS deny_count,
          coalesce(bool_or(is_policy), false) AS has_policy,
          coalesce(bool_or(is_credit_override), false) AS has_credit_override
        FROM requests r JOIN accounts a USING (account_id) LEFT JOIN flags f ON f.request_id = r.request_id
        GROUP BY r.request_id""",
    "security": """SELECT account_id, arg_max(ticket_id, (created_at, ticket_id)) AS security_ticket_id
        FROM tickets WHERE lower(subject) = 'possible api key exposure' GROUP BY account_id""",
    "context": """SELECT r.request_id, r.query, r.account_id, r.order_id, r.requested_at, a.account_name, a.plan,
          a.account_id IS NOT NULL AS account_found, o.order_id IS NOT NULL AS order_found,
          o.status AS order_status, o.account_id <> r.account_id AS order_account_mismatch,
          cast(o.shipment_fee_inr AS double) AS fee, o.carrier_fault, o.customer_fault, o.pickup_window_end,
          o.booked_at, s.security_ticket_id, coalesce(e.best_score, 0) AS best, coalesce(e.agreement_count, 0) AS agree,
          coalesce(e.deny_count, 0) AS deny, coalesce(e.has_policy, false) AS policy,
          coalesce(e.has_credit_override, false) AS override_
        FROM requests r LEFT JOIN accounts a ON a.account_id = r.account_id
        LEFT JOIN shipments o ON o.order_id = r.order_id
        LEFT JOIN security s ON s.account_id = a.account_id LEFT JOIN summary e ON e.request_id = r.request_id""",
    "ruled": """SELECT *, CASE WHEN query = '' THEN 'query cannot be empty'
            WHEN NOT account_found THEN 'load structured context: load account: get account ' || account_id
              || ': no rows in result set'
            WHEN order_id <> '' AND NOT order_found THEN 'load structured context: load order: get order '
              || order_id || ': no rows in result set' END AS error,
          CASE WHEN security_ticket_id IS NOT NULL THEN 2 WHEN NOT order_found THEN 3
            WHEN order_status = 'PICKED_UP' THEN 4 WHEN order_status = 'RETURN_TO_ORIGIN' THEN 5
            WHEN order_status = 'DELIVERED' THEN 6 WHEN order_status = 'CANCELLED' THEN 7
            WHEN order_status <> 'BOOKED' THEN 13 WHEN agree > 0 AND deny > 0 THEN 8
            WHEN agree > 0 AND best >= 0.6 THEN 9 WHEN agree > 0 THEN 10 WHEN policy THEN 11 ELSE 12 END AS rule
        FROM context""",
    "decisions": """SELECT request_id, account_id, order_id, plan, error, order_account_mismatch,
          rule = 9 AS allowed, rule IN (3, 8, 10, 11, 12, 13) AS needs_agent, rule IN (2, 8) AS escalate,
          CASE WHEN rule IN (2, 4, 5, 6, 7) THEN 1.0 WHEN rule = 9 THEN 0.95
            WHEN rule IN (10, 11, 12) THEN best ELSE 0.0 END AS confidence,
          CASE rule WHEN 2 THEN 'suspected production credential exposure requires P1 handling'
            WHEN 3 THEN 'order context is required'
            WHEN 4 THEN 'picked-up shipments cannot be cancelled; use return-to-origin'
            WHEN 5 THEN 'order is already marked for return-to-origin'
            WHEN 6 THEN 'delivered shipments cannot be cancelled'
            WHEN 7 THEN 'order is already cancelled'
            WHEN 8 THEN 'conflicting customer agreements found for ' || account_name || '; cancellation of order '
              || order_id || ' requires verification'
            WHEN 9 THEN account_name || ' may cancel BOOKED order ' || order_id
              || ' before pickup with no cancellation fee under the active customer agreement'
            WHEN 10 THEN 'customer agreement appears to permit cancellation of BOOKED order ' || order_id
              || ', but evidence confidence is insufficient for an automatic action'
            WHEN 11 THEN 'BOOKED order ' || order_id
              || ' may be cancellable under the default policy, but no customer-specific agreement was verified'
            WHEN 12 THEN 'BOOKED order ' || order_id || ' requires policy/agreement evaluation'
            ELSE 'no deterministic rule for order status ' || order_status END AS reason,
          CASE rule WHEN 2 THEN 'ESCALATE' WHEN 4 THEN 'RETURN_TO_ORIGIN' WHEN 9 THEN 'CANCEL_ORDER' END AS action_type,
          CASE rule WHEN 2 THEN security_ticket_id WHEN 4 THEN order_id WHEN 9 THEN order_id END AS action_target,
          CASE rule WHEN 2 THEN 'suspected API key exposure' WHEN 4 THEN 'shipment already picked up'
            WHEN 9 THEN 'active customer agreement overrides the default cancellation fee policy' END AS action_reason
        FROM ruled""",
    "actions": """SELECT event_id AS seq,
          ['CANCEL_ORDER', 'CANCEL_ORDER', 'RETURN_TO_ORIGIN', 'SERVICE_CREDIT', 'SERVICE_CREDIT_APPROVAL',
           'ESCALATE', 'REFUND'][event_id % 7 + 1] AS action_type,
          CASE WHEN event_id % 71 = 0 THEN '' WHEN event_id % 7 = 5 THEN 'TCK-' || (event_id - event_id % 3)
            ELSE 'ORD-' || (event_id // 4) END AS target_id,
          'r' || event_id AS reason, ts AS acted_at
        FROM events WHERE event_type IN ('purchase', 'signup')""",
    "credits0": """SELECT k AS id, order_id, account_id, cast(10 + k % 90 AS decimal(12,2)) AS amount_inr,
          'earlier' AS reason, ['PENDING_APPROVAL', 'APPROVED', 'ISSUED', 'REJECTED'][k % 4 + 1] AS status,
          'agent' AS requested_by, booked_at AS created_at FROM shipments WHERE carrier = '1-URGENT'""",
    "escalations0": """SELECT k AS id, ticket_id, account_id, 'earlier' AS reason, if(k % 2 = 0, 'P1', 'P2') AS priority,
          if(k % 2 = 0, 'created', 'cancelled') AS status, 'agent' AS requested_by, created_at
        FROM tickets WHERE status = 'closed'""",
    "checked": """SELECT *, CASE WHEN action_type = 'REFUND' THEN 'unsupported action type: REFUND'
            WHEN target_id <> '' THEN NULL
            WHEN action_type = 'ESCALATE' THEN 'ticket ID is required for escalation'
            WHEN action_type = 'SERVICE_CREDIT' THEN 'order ID is required for service credit'
            WHEN action_type = 'SERVICE_CREDIT_APPROVAL' THEN 'order ID is required for service credit approval'
            ELSE 'order ID is required' END AS refused
        FROM actions""",
    "states": """SELECT c.*, coalesce(o.account_id, t.account_id) AS account_id, coalesce(o.status, t.status) AS first_status,
          least(cast(o.shipment_fee_inr AS double) * 0.1::DOUBLE, 500.0::DOUBLE) AS credit,
          CASE WHEN c.refused IS NOT NULL THEN c.refused
            WHEN coalesce(o.status, t.status) IS NULL THEN 'load ' || if(action_type = 'ESCALATE', 'ticket ', 'order ')
              || target_id || CASE action_type WHEN 'SERVICE_CREDIT' THEN ' for service credit'
                WHEN 'SERVICE_CREDIT_APPROVAL' THEN ' for credit approval' ELSE '' END
              || ': no rows in result set' END AS early_error
        FROM checked c LEFT JOIN shipments o ON c.refused IS NULL AND c.action_type <> 'ESCALATE' AND o.order_id = c.target_id
        LEFT JOIN tickets t ON c.refused IS NULL AND c.action_type = 'ESCALATE' AND t.ticket_id = c.target_id""",
    "stepped": """SELECT *, CASE
            WHEN first_status = 'BOOKED' AND count(*) FILTER (action_type = 'CANCEL_ORDER') OVER before > 0 THEN 'CANCELLED'
            WHEN first_status = 'PICKED_UP' AND count(*) FILTER (action_type = 'RETURN_TO_ORIGIN') OVER before > 0
              THEN 'RETURN_TO_ORIGIN' ELSE first_status END AS status_before
        FROM states WINDOW before AS (PARTITION BY early_error IS NULL, target_id ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "outcomes": """SELECT seq, action_type, target_id, reason, acted_at, account_id, status_before,
          CASE WHEN outcome = 'executed' AND action_type LIKE 'SERVICE%' THEN credit END AS amount, outcome, error
        FROM (SELECT *, CASE WHEN error IS NOT NULL THEN 'error'
            WHEN action_type = 'CANCEL_ORDER' THEN if(status_before = 'BOOKED', 'executed', 'noop')
            WHEN action_type = 'RETURN_TO_ORIGIN' THEN if(status_before = 'PICKED_UP', 'executed', 'noop')
            WHEN action_type = 'ESCALATE' THEN if(nth_escalation = 1 AND target_id NOT IN
              (SELECT ticket_id FROM escalations0 WHERE status = 'created'), 'executed', 'noop')
            ELSE if(nth_credit = 1 AND target_id NOT IN
              (SELECT order_id FROM credits0 WHERE status <> 'REJECTED'), 'executed', 'noop') END AS outcome
          FROM (SELECT *,
              row_number() OVER (PARTITION BY action_type = 'ESCALATE' AND error IS NULL, target_id ORDER BY seq) AS nth_escalation,
              row_number() OVER (PARTITION BY action_type LIKE 'SERVICE%' AND error IS NULL, target_id ORDER BY seq) AS nth_credit
            FROM (SELECT *, CASE WHEN early_error IS NOT NULL THEN early_error
                WHEN action_type = 'CANCEL_ORDER' AND status_before NOT IN ('BOOKED', 'CANCELLED')
                  THEN 'cannot cancel order ' || target_id || ' in status ' || status_before
                WHEN action_type = 'RETURN_TO_ORIGIN' AND status_before NOT IN ('PICKED_UP', 'RETURN_TO_ORIGIN')
                  THEN 'cannot return order ' || target_id || ' to origin in status ' || status_before
                WHEN action_type = 'SERVICE_CREDIT' AND status_before <> 'BOOKED'
                  THEN 'cannot issue service credit for order ' || target_id || ' in status ' || status_before
                WHEN action_type = 'SERVICE_CREDIT_APPROVAL' AND status_before <> 'BOOKED'
                  THEN 'cannot request service credit approval for order ' || target_id || ' in status ' || status_before
                END AS error FROM stepped)))""",
    "audit": """SELECT seq AS id, account_id, action_type, target_id, reason,
          CASE action_type WHEN 'CANCEL_ORDER' THEN 'BOOKED' WHEN 'RETURN_TO_ORIGIN' THEN 'PICKED_UP' END AS previous_status,
          CASE action_type WHEN 'CANCEL_ORDER' THEN 'CANCELLED' WHEN 'RETURN_TO_ORIGIN' THEN 'RETURN_TO_ORIGIN'
            WHEN 'ESCALATE' THEN 'created' WHEN 'SERVICE_CREDIT' THEN 'ISSUED' ELSE 'PENDING_APPROVAL' END AS new_status,
          if(action_type = 'ESCALATE', 'P1', NULL) AS priority,
          if(action_type IN ('CANCEL_ORDER', 'RETURN_TO_ORIGIN'), NULL, 'agent') AS requested_by,
          round(amount, 6) AS amount_inr, acted_at
        FROM outcomes WHERE outcome = 'executed'""",
    "proposals": """SELECT 'CNF-' || event_id AS confirmation_id, ts AS created_at,
          if(event_id % 2 = 0, 'CANCEL_ORDER', 'RETURN_TO_ORIGIN') AS action_type,
          'ORD-' || (event_id // 4) AS target_id, 'r' || event_id AS reason FROM events WHERE event_type = 'view'""",
    "answers": """SELECT 'CNF-' || event_id AS confirmation_id, event_id * 2 AS seq,
          ts + to_minutes(event_id % 12) AS answered_at, event_id % 4 <> 0 AS confirm
        FROM events WHERE event_type = 'view' AND (event_id % 9 <> 0 OR event_id % 10 = 7)
        UNION ALL SELECT 'CNF-' || event_id, event_id * 2 + 1, ts - INTERVAL 1 MINUTE, true
        FROM events WHERE event_type = 'view' AND event_id % 10 = 7
        UNION ALL SELECT 'CNF-' || event_id, event_id * 2 + 1, ts + to_minutes(event_id % 12 + 1), event_id % 4 <> 0
        FROM events WHERE event_type = 'view' AND event_id % 9 <> 0 AND event_id % 6 = 0
        UNION ALL SELECT 'CNF-X' || event_id, event_id * 2, ts, true
        FROM events WHERE event_type = 'signup' AND event_id % 25 = 0""",
    "judged": """SELECT a.*, p.created_at, p.action_type, p.target_id, p.reason,
          p.confirmation_id IS NOT NULL AND a.answered_at >= p.created_at AS met,
          row_number() OVER (PARTITION BY a.confirmation_id, p.confirmation_id IS NOT NULL AND a.answered_at >= p.created_at
            ORDER BY a.answered_at, a.seq) AS nth,
          a.answered_at <= p.created_at + INTERVAL 10 MINUTE AS in_time
        FROM answers a LEFT JOIN proposals p USING (confirmation_id)""",
    "raw_accounts": """SELECT 1::BIGINT AS row_no, ['account_id'] AS cells UNION ALL
        SELECT c_custkey + 2, list_slice(['ACCT-' || if(c_custkey % 19 = 5, c_custkey - 1, c_custkey), c_name,
          CASE WHEN c_custkey % 41 = 7 THEN 'Gold' WHEN c_mktsegment = 'BUILDING' THEN 'Enterprise'
            WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Growth' ELSE 'Standard' END,
          if(c_acctbal < 0, 'Suspended', 'Active'), if(c_custkey % 5 = 0, '  ', ' csm' || (c_custkey % 7) || ' '),
          if(c_custkey % 3 = 0, 'f' || c_custkey || '.pdf', ''),
          CASE WHEN c_custkey % 29 = 3 THEN 'yes' WHEN c_acctbal > 8000 THEN 'TRUE' ELSE 'f' END,
          'note ' || c_custkey], 1, if(c_custkey % 37 = 11, 6, 8)) FROM customer""",
    "raw_orders": """SELECT 1::BIGINT AS row_no, ['order_id'] AS cells UNION ALL
        SELECT o_orderkey + 2, list_slice(['ORD-' || if(o_orderkey % 23 = 9, o_orderkey - 1, o_orderkey),
          'ACCT-' || o_custkey, o_orderpriority,
          CASE o_orderstatus WHEN 'O' THEN 'BOOKED' WHEN 'P' THEN 'PICKED_UP'
            ELSE if(o_orderkey % 43 = 1, 'LOST', 'DELIVERED') END,
          if(o_orderkey % 47 = 2, '2026-02-30 10:00', ' ' || strftime(o_orderdate, '%Y-%m-%d') || ' 09:30 '),
          if(o_orderkey % 4 = 0, '', strftime(o_orderdate, '%Y-%m-%d') || ' 9:05'),
          if(o_orderkey % 53 = 3, 'soon', strftime(o_orderdate, '%Y-%m-%d') || ' 18:00'),
          '   ',
          CASE WHEN o_orderkey % 59 = 4 THEN 'INR 20' WHEN o_orderkey % 61 = 5 THEN '1e11'
            ELSE cast(cast(cast(o_totalprice AS varchar) AS decimal(12,2)) AS varchar) END,
          if(o_orderkey % 3 = 0, '0', '1'),
          CASE WHEN o_orderkey % 67 = 6 THEN 'no' WHEN o_orderkey % 7 = 0 THEN 'T' ELSE 'False' END,
          if(o_orderkey % 71 = 7, '10:00', ''), if(o_orderkey % 2 = 0, '', '  n' || o_orderkey)],
          1, if(o_orderkey % 73 = 8, 12, 13)) FROM orders""",
    "raw_tickets": """SELECT 1::BIGINT AS row_no, ['ticket_id'] AS cells UNION ALL
        SELECT event_id + 2, list_slice(['TCK-' || if(event_id % 17 = 4, event_id % 300, event_id), 'ACCT-' || user_id,
          CASE WHEN event_id % 31 = 1 THEN '' WHEN event_id % 37 = 2 THEN 'yesterday'
            ELSE strftime(ts, '%Y-%m-%d %H:%M') END,
          if(event_id % 3 = 0, 'closed', 'open'), 'Pickup delayed', event_type,
          if(event_id % 2 = 0, ' email ', ''), '',
          CASE WHEN event_id % 41 = 3 THEN '2024/01/01 10:00'
            WHEN event_id % 5 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M') ELSE '' END,
          'fixed ' || event_id], 1, CASE WHEN event_id % 43 = 5 THEN 8 WHEN event_id % 4 = 0 THEN 9 ELSE 10 END)
        FROM events WHERE event_type = 'error'""",
    "p_accounts": f"""SELECT row_no, cells[1] AS account_id, cells[2] AS account_name, cells[3] AS plan, cells[4] AS status,
          nullif({_trim('cells[5]')}, '') AS csm, nullif({_trim('cells[6]')}, '') AS contract_file,
          {_bool('cells[7]')} AS premium_support, nullif({_trim('cells[8]')}, '') AS notes,
          CASE WHEN len(cells) < 8 THEN 'accounts row ' || row_no || ' has ' || len(cells) || ' columns, expected 8'
            WHEN ({_bool('cells[7]')}) IS NULL THEN 'accounts row ' || row_no || ': invalid premium_support'
            WHEN cells[3] NOT IN ('Standard', 'Growth', 'Enterprise')
              THEN 'insert account row ' || row_no || ': plan is not allowed' END AS reject_reason
        FROM raw_accounts WHERE row_no > 1""",
    "p_orders": f"""SELECT row_no, cells[1] AS order_id, cells[2] AS account_id, cells[3] AS carrier, cells[4] AS status,
          {_time('cells[5]')} AS booked_at, {_time('cells[6]')} AS pickup_window_start,
          {_time('cells[7]')} AS pickup_window_end, {_time('cells[8]')} AS pickup_actual_at,
          {_stored(_fee('cells[9]'))} AS shipment_fee_inr, {_bool('cells[10]')} AS carrier_fault,
          {_bool('cells[11]')} AS customer_fault, {_time('cells[12]')} AS cancellation_requested_at,
          nullif({_trim('cells[13]')}, '') AS notes,
          CASE WHEN len(cells) < 13 THEN 'orders row ' || row_no || ' has ' || len(cells) || ' columns, expected 13'
            WHEN {_bad_time('cells[5]')} THEN 'orders row ' || row_no || ' booked_at'
            WHEN {_bad_time('cells[6]')} THEN 'orders row ' || row_no || ' pickup_window_start'
            WHEN {_bad_time('cells[7]')} THEN 'orders row ' || row_no || ' pickup_window_end'
            WHEN {_bad_time('cells[8]')} THEN 'orders row ' || row_no || ' pickup_actual_at'
            WHEN {_bad_time('cells[12]')} THEN 'orders row ' || row_no || ' cancellation_requested_at'
            WHEN {_fee('cells[9]')} IS NULL THEN 'orders row ' || row_no || ' shipment_fee_inr'
            WHEN ({_bool('cells[10]')}) IS NULL THEN 'orders row ' || row_no || ' carrier_fault'
            WHEN ({_bool('cells[11]')}) IS NULL THEN 'orders row ' || row_no || ' customer_fault'
            WHEN {_stored(_fee('cells[9]'))} IS NULL
              THEN 'insert order row ' || row_no || ': shipment_fee_inr is out of range'
            WHEN cells[4] NOT IN ('DRAFT', 'BOOKED', 'PICKED_UP', 'RETURN_TO_ORIGIN', 'DELIVERED', 'CANCELLED')
              THEN 'insert order row ' || row_no || ': status is not allowed' END AS reject_reason
        FROM raw_orders WHERE row_no > 1""",
    "p_tickets": f"""SELECT row_no, cells[1] AS ticket_id, cells[2] AS account_id, {_time('cells[3]')} AS created_at,
          cells[4] AS status, cells[5] AS subject, cells[6] AS description, nullif({_trim('cells[7]')}, '') AS channel,
          nullif({_trim('cells[8]')}, '') AS assigned_to, {_time('cells[9]')} AS last_customer_message_at,
          nullif({_trim('cells[10]')}, '') AS historical_resolution,
          CASE WHEN len(cells) < 9 THEN 'tickets row ' || row_no || ' has ' || len(cells) || ' columns, expected at least 9'
            WHEN {_bad_time('cells[3]')} THEN 'tickets row ' || row_no || ' created_at'
            WHEN {_bad_time('cells[9]')} THEN 'tickets row ' || row_no || ' last_customer_message_at'
            WHEN {_time('cells[3]')} IS NULL THEN 'insert ticket row ' || row_no || ': created_at is required'
            END AS reject_reason
        FROM raw_tickets WHERE row_no > 1""",
    "registry": """SELECT 'd' || doc_id || '.pdf' AS filename, source || ' ' || doc_id AS title,
          ['support_policy', 'cancellation_sop', 'customer_agreement'][doc_id % 3 + 1] AS document_type,
          ['DEPRECATED', 'ACTIVE', 'CURRENT', 'CURRENT'][doc_id % 4 + 1] AS status, doc_id % 4 + 1 AS authority_rank,
          if(doc_id % 3 = 2, 'ACCT-' || (doc_id % 50), NULL) AS account_id, doc_id
        FROM documents WHERE source <> 'src1'""",
    "files": """SELECT doc_id AS document_id, 'd' || doc_id || CASE doc_id % 13 WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt'
          ELSE '.pdf' END AS filename FROM documents""",
    "chunk_source": """SELECT doc_id AS document_id, CASE doc_id % 4
          WHEN 1 THEN replace(text, chr(10), ' ' || chr(13) || chr(10) || chr(9))
          WHEN 2 THEN replace(text, chr(10), chr(13)) ELSE text END AS text FROM documents""",
    "doc_text": """SELECT doc_id AS document_id, text, lang FROM documents""",
    "chunk_vectors": """SELECT vec_id AS chunk_id, label::BIGINT AS document_id, 'chunk ' || vec_id AS content,
          if(vec_id % 17 = 0, NULL, embedding) AS embedding FROM embeddings""",
    "bodies": r"""SELECT request_id, CASE request_id % 11
            WHEN 0 THEN '{"query": "' || query || '", "account_id":'
            WHEN 1 THEN '{"query": "' || query || '"} {"account_id": "' || account_id || '"}'
            WHEN 2 THEN '{"query": ' || request_id || ', "account_id": "a", "order_id": "o"}'
            WHEN 3 THEN '{"query": "' || query || '", "order_id": "' || order_id || '"}'
            WHEN 4 THEN '{"query": "' || query || '", "extra": [1, {"x": null}], "order_id": "' || order_id
              || '", "account_id": " ' || account_id || ' "}'
            WHEN 5 THEN '{"query": null, "account_id": "' || account_id || '"}'
            WHEN 6 THEN '{"query": "  \t ", "account_id": "' || account_id || '"}'
            WHEN 7 THEN '["' || query || '"]'
            ELSE ' {"query": " ' || query || ' ", "account_id": "' || account_id || '", "order_id": "' || order_id || '"} '
          END AS body FROM requests""",
    "answer_bodies": """SELECT seq, CASE seq % 7
            WHEN 0 THEN '{"confirmation_id": "' || confirmation_id || '"'
            WHEN 1 THEN '{"confirmation_id": "' || confirmation_id || '"}'
            WHEN 2 THEN '{"confirmation_id": "' || confirmation_id || '", "confirm": "yes"}'
            WHEN 3 THEN '{"confirm": true}'
            ELSE '{"confirmation_id": " ' || confirmation_id || ' ", "confirm": ' || confirm || '}' END AS body
        FROM answers""",
}


def _clean_text(x: str) -> str:
    lf = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return (f"array_to_string(list_filter(list_transform(string_split({lf}, chr(10)), lambda l: {_trim('l')}), "
            "lambda l: l <> ''), chr(10))")


def _chunks(name: str, source: str, limit: int = 1200) -> dict[str, str]:
    """Paragraphs numbered, folded one step at a time, then put together per chunk."""
    return {
        f"{name}_lines": f"""SELECT document_id, n, lines[n] AS line, strlen(lines[n]) AS bytes
          FROM (SELECT document_id, string_split({_clean_text('text')}, chr(10)) AS lines FROM {source}),
            LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS n) WHERE lines[n] <> ''""",
        f"{name}_fold(document_id, n, chunk_index, size)": f"""SELECT document_id, n, 0::BIGINT, bytes FROM {name}_lines WHERE n = 1
          UNION ALL SELECT l.document_id, l.n, if(f.size + 1 + l.bytes > {limit}, f.chunk_index + 1, f.chunk_index),
            if(f.size + 1 + l.bytes > {limit}, l.bytes, f.size + 1 + l.bytes)
          FROM {name}_fold f JOIN {name}_lines l ON l.document_id = f.document_id AND l.n = f.n + 1""",
        name: f"""SELECT document_id, chunk_index, string_agg(line, chr(10) ORDER BY n) AS content
          FROM {name}_fold JOIN {name}_lines USING (document_id, n) GROUP BY document_id, chunk_index""",
    }


_CTES |= _chunks("chunks", "chunk_source") | _chunks("plain_chunks", "doc_text")
_CTES |= {"english": "SELECT document_id, text FROM doc_text WHERE lang = 'en'"}
_CTES |= _chunks("short_chunks", "english", 600)


_MASK = "4294967295::UBIGINT"


def _rotl(x: str, n: int) -> str:
    return f"(((({x}) << {n}) | (({x}) >> {32 - n})) & {_MASK})"


def _times(x: str, c: int) -> str:
    return f"((({x}) * {c}::UBIGINT) & {_MASK})"


def _murmur3(column: str, source: str) -> str:
    """(term, h) with the 32-bit MurmurHash3, seed 42, of each distinct term's UTF-8 bytes."""
    mixed = _times(_rotl(_times("k", 0xCC9E2D51), 15), 0x1B873593)
    step = f"(({_times(_rotl('xor(h, k)', 13), 5)} + 3864292196::UBIGINT) & {_MASK})"
    word = "".join(f" || substr(x, {8} * i + {o}, 2)" for o in (7, 5, 3, 1))[4:]
    tail = " || ".join(f"coalesce(nullif(substr(x, 8 * (n // 4) + {o}, 2), ''), '00')" for o in (7, 5, 3, 1))
    return f"""SELECT t, xor(f, f >> 16) AS h FROM (SELECT t, {_times('xor(e, e >> 13)', 0xC2B2AE35)} AS f
      FROM (SELECT t, {_times('xor(d, d >> 16)', 0x85EBCA6B)} AS e
      FROM (SELECT t, xor(xor(list_reduce(ks, lambda h, k: {step}, 42::UBIGINT), if(n % 4 = 0, 0::UBIGINT, last)), n::UBIGINT) AS d
      FROM (SELECT t, n, list_transform(ks, lambda k: {mixed}) AS ks, {mixed.replace('(k)', '(k1)')} AS last
      FROM (SELECT t, n, list_transform(range(n // 4), lambda i: ('0x' || {word})::UBIGINT) AS ks, ('0x' || {tail})::UBIGINT AS k1
      FROM (SELECT t, strlen(t) AS n, hex(encode(t)) AS x FROM (SELECT DISTINCT {column} AS t FROM {source})))))))"""


def _hashed(name: str, source: str, keys: str, column: str, by_digest: bool = False) -> dict[str, str]:
    """Normalised hashed term counts as (keys, slot, weight).

    The slot is the signed term hash modulo the width, brought above zero; or from the MD5.
    """
    slot = "('0x' || left(md5(t), 8))::BIGINT % 64" if by_digest else "(h & 63)::BIGINT"
    hashes = "" if by_digest else f" JOIN {name}_hash USING (t)"
    parts = {
        f"{name}_terms": f"""SELECT {keys}, t FROM (SELECT {keys}, unnest(string_split({_match(column)}, ' ')) AS t
          FROM {source}) WHERE t <> ''""",
        f"{name}_slots": f"SELECT {keys}, {slot} AS slot, count(*)::DOUBLE AS n FROM {name}_terms{hashes} GROUP BY ALL",
        name: f"""SELECT {keys}, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY {keys})))::FLOAT::DOUBLE AS weight
          FROM {name}_slots""",
    }
    return parts if by_digest else parts | {f"{name}_hash": _murmur3("t", f"{name}_terms")}


_CTES |= _hashed("doc_vectors", "documents", "doc_id", "text")
_CTES |= _hashed("digest_vectors", "chunks", "document_id, chunk_index", "content", by_digest=True)
_CTES |= _hashed("backlog_vectors", "(SELECT * FROM chunk_vectors WHERE embedding IS NULL)", "chunk_id", "content")
_CTES |= _hashed("text_vectors", "chunks", "document_id, chunk_index", "content")
_CTES |= _hashed("item_vectors", "benchmark", "item_id", "text")


# The same rules over evidence found by search.
_CTES |= {
    "r_requests": "SELECT * FROM requests",
    "policy_chunks": """SELECT document_id, content FROM policy_docs
        UNION ALL SELECT 0, 'An order that is BOOKED, not yet PICKED_UP may be cancelled.'""",
    "r_texts": "SELECT DISTINCT query FROM r_requests WHERE query <> ''",
    **_hashed("policy_vectors", "policy_chunks", "document_id", "content"),
    **_hashed("question_vectors", "r_texts", "query", "query"),
    "r_hits": """SELECT query, rank, document_id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY query
          ORDER BY round(s, 9) DESC, document_id) AS rank
        FROM (SELECT q.query, c.document_id, sum(q.weight * c.weight) / any_value(q.size * c.size) AS s
          FROM (SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY query)) AS size FROM question_vectors) q
          JOIN (SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY document_id)) AS size FROM policy_vectors) c
            USING (slot) GROUP BY q.query, c.document_id)) WHERE rank <= 5""",
    "r_evidence": """SELECT request_id, document_id, content, score
        FROM r_requests JOIN r_hits USING (query) JOIN policy_chunks USING (document_id)""",
}
_SEARCHED = ("requests", "evidence", "flags", "summary", "context", "ruled", "decisions")
for _name in _SEARCHED[2:]:
    _CTES[f"r_{_name}"] = re.sub(rf"(?<=FROM |JOIN )({'|'.join(_SEARCHED)})\b", r"r_\1", _CTES[_name])


def _with(query: str) -> str:
    """The query with the derived tables it mentions, each after those it mentions itself."""
    names = {head.split("(")[0]: head for head in _CTES}
    needed: list[str] = []

    def need(sql: str, owner: str = "") -> None:
        words = set("".join(c if c.isalnum() or c == "_" else " " for c in sql).split())
        for name in names:
            if name in words and name != owner and name not in needed:
                need(_CTES[names[name]], name)
                needed.append(name)

    need(query)
    if not needed:
        return query
    body = ",\n".join(f"{names[n]} AS ({_CTES[names[n]]})" for n in needed)
    return f"WITH RECURSIVE {body}\n{query}"


def _upsert(table: str, key: str, target: str, columns: list[str], created: str = "created_at",
            before: str = "'2024-01-01 00:00:00.000000'") -> str:
    """Full outer join of what was there and the last good row per key."""
    picked = ", ".join(f"if(s.{key} IS NOT NULL, s.{c}, t.{c}) AS {c}" for c in columns)
    now = "'2024-02-01 00:00:00.000000'"
    return f"""SELECT coalesce(t.{key}, s.{key}) AS {key}, {picked}, if(t.{key} IS NULL, {now}, {before}) AS {created},
        if(s.{key} IS NULL, {before}, {now}) AS updated_at
      FROM ({target}) t FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY row_no DESC) AS rn
        FROM p_{table} WHERE reject_reason IS NULL) WHERE rn = 1) s ON s.{key} = t.{key}"""


_ORDER_TIMES = ["booked_at", "pickup_window_start", "pickup_window_end", "pickup_actual_at",
                "cancellation_requested_at"]


def _as_text(columns: list[str], inner: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{_ts(c)} AS {c}' for c in columns)}) FROM ({inner})"


_UPSERT_ORDERS = _as_text(_ORDER_TIMES, _upsert("orders", "order_id",
    """SELECT * REPLACE (shipment_fee_inr::DOUBLE AS shipment_fee_inr), NULL::TIMESTAMP AS pickup_window_start,
    NULL::TIMESTAMP AS pickup_actual_at, NULL::TIMESTAMP AS cancellation_requested_at, NULL::VARCHAR AS notes
    FROM shipments WHERE status <> 'BOOKED'""",
    ["account_id", "carrier", "status", *_ORDER_TIMES, "shipment_fee_inr", "carrier_fault", "customer_fault", "notes"]))


_DAILY_RATE = """SELECT strftime(requested_at, '%Y-%m-%d') AS day, plan, count(*) FILTER (error IS NULL) AS eligible,
    count(*) FILTER (error IS NULL AND NOT escalate AND NOT needs_agent) AS resolved,
    round(count(*) FILTER (error IS NULL AND NOT escalate AND NOT needs_agent)
      / nullif(count(*) FILTER (error IS NULL), 0), 6) AS rate
    FROM decisions JOIN (SELECT request_id, requested_at FROM requests) USING (request_id) GROUP BY day, plan"""


def _credit_sql(cap: float) -> str:
    return f"""SELECT request_id, account_id, order_id, rule = 9 AS allowed, rule IN (1, 2, 3, 8) AS needs_agent,
      false AS escalate, if(rule IN (1, 2), 0.0, 1.0)::DOUBLE AS confidence,
      CASE rule WHEN 1 THEN 'account context is required'
        WHEN 2 THEN 'order context is required for service-credit evaluation'
        WHEN 3 THEN 'pickup window end is unknown; service-credit eligibility cannot be verified'
        WHEN 4 THEN 'pickup is not more than 2 hours past the scheduled pickup window'
        WHEN 5 THEN 'carrier fault is not confirmed'
        WHEN 6 THEN 'customer-caused issue makes the order ineligible for a service credit'
        WHEN 7 THEN 'pickup is not more than 4h0m0s past the scheduled pickup window'
        WHEN 8 THEN 'service credit of INR ' || money || ' requires manager approval' ELSE granted END AS reason,
      CASE rule WHEN 8 THEN 'SERVICE_CREDIT_APPROVAL' WHEN 9 THEN 'SERVICE_CREDIT' END AS action_type,
      if(rule IN (8, 9), order_id, NULL) AS action_target,
      CASE rule WHEN 8 THEN 'manager approval required for INR ' || money || ' service credit' WHEN 9 THEN granted END AS action_reason
    FROM (SELECT *, printf('%.2f', credit) AS money,
        'order ' || order_id || ' qualifies for INR ' || printf('%.2f', credit) || ' service credit'
          || if(override_, ' under the active customer agreement', '') AS granted,
        CASE WHEN NOT account_found THEN 1 WHEN NOT order_found THEN 2 WHEN pickup_window_end IS NULL THEN 3
          WHEN requested_at < pickup_window_end + INTERVAL 2 HOUR THEN 4 WHEN NOT carrier_fault THEN 5
          WHEN customer_fault THEN 6 WHEN override_ AND requested_at < pickup_window_end + INTERVAL 4 HOUR THEN 7
          WHEN credit > 1000 THEN 8 ELSE 9 END AS rule
      FROM (SELECT *, if(override_, 300.0::DOUBLE, least(fee * 0.1::DOUBLE, {cap}::DOUBLE)) AS credit FROM context))"""


_DECISION_COLUMNS = "request_id, account_id, order_id, error, order_account_mismatch"
_EVALUATE = f"SELECT {_DECISION_COLUMNS}, " + ", ".join(
    f"if(error IS NULL, {c}, NULL) AS {c}"
    for c in ("allowed", "needs_agent", "escalate", "confidence", "reason", "action_type", "action_target",
              "action_reason")
) + ", if(error IS NULL, reason, NULL) AS answer FROM decisions"
_OUTCOMES = f"""SELECT seq, action_type, target_id, reason, {_ts('acted_at')} AS acted_at, account_id, status_before,
  round(amount, 6) AS amount, outcome, error FROM outcomes"""

_GATED = _EVALUATE.replace(" FROM decisions", """, ok AS confirmation_required,
    if(ok, sha256(request_id || '|' || action_type || '|' || action_target), NULL) AS confirmation_id
    FROM (SELECT *, error IS NULL AND action_type IS NOT NULL AND confidence >= 0.9 AS ok FROM decisions)""")


def _typed(kind: str) -> str:
    return f"""SELECT seq, target_id, status_before, outcome, error, round(amount, 6) AS amount
      FROM outcomes WHERE action_type = '{kind}'"""


_AUDIT = f"SELECT * EXCLUDE (acted_at), {_ts('acted_at')} AS created_at FROM audit"

_TOPK = """SELECT query_id, rank, chunk_id, score, document_id, content FROM (
  SELECT q.query_id, c.chunk_id, c.document_id, c.content, round(score, 6) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
  FROM (SELECT label::BIGINT AS query_id, list(m ORDER BY i) AS v FROM (
      SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i)
    GROUP BY label) q,
    (SELECT *, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE embedding IS NOT NULL) c,
    LATERAL (SELECT list_cosine_similarity(q.v, c.e) AS score)) WHERE rank <= 5"""

_FOREIGN_KEYS = [
    ("p_orders", "orders", "account_id", "order_id", "p_accounts", "account_id", "accounts"),
    ("p_tickets", "tickets", "account_id", "ticket_id", "p_accounts", "account_id", "accounts"),
    ("i_documents", "documents", "account_id", "filename", "p_accounts", "account_id", "accounts"),
    ("i_document_chunks", "document_chunks", "document_id", "id", "i_documents", "id", "documents"),
    ("i_escalations", "escalations", "ticket_id", "id", "p_tickets", "ticket_id", "tickets"),
    ("i_escalations", "escalations", "account_id", "id", "p_accounts", "account_id", "accounts"),
    ("i_audit_logs", "audit_logs", "account_id", "id", "p_accounts", "account_id", "accounts"),
    ("i_service_credits", "service_credits", "order_id", "id", "p_orders", "order_id", "orders"),
    ("i_service_credits", "service_credits", "account_id", "id", "p_accounts", "account_id", "accounts"),
]


def _faulty(name: str, source: str) -> str:
    """A table with its planted faults."""
    cases = ", ".join(f"{e} AS {c}" for c, e in fault_cases(name).items())
    rows = f"SELECT * REPLACE ({cases}) FROM {source}"
    return f"{rows} UNION ALL {rows} WHERE ({FAULTS[name][0]}) % 89 = 3"


_CTES |= {
    "known_docs": """SELECT doc_id AS id, *, 'x' AS metadata FROM registry""",
    "id_chunks": """SELECT document_id || ':' || chunk_index AS id, document_id, chunk_index, content, '{}' AS metadata
        FROM chunks""",
    "audit0": """SELECT event_id AS id, 'ACCT-' || user_id AS account_id, 'CANCEL_ORDER' AS action_type,
          'ORD-' || event_id AS target_id, 'r' || event_id AS reason FROM events WHERE event_type = 'purchase'""",
    "i_documents": _faulty("documents", "known_docs"),
    "i_document_chunks": _faulty("document_chunks", "id_chunks"),
    "i_escalations": _faulty("escalations", "escalations0"),
    "i_audit_logs": _faulty("audit_logs", "audit0"),
    "i_service_credits": _faulty("service_credits", "credits0"),
}


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _nulls(source: str, table: str, key: str, columns: list[str]) -> list[str]:
    return [f"SELECT '{table}.{c} not null' AS rule, coalesce({key}::VARCHAR, '') AS key FROM {source} WHERE {c} IS NULL"
            for c in columns]


def _repeats(source: str, table: str, key: str) -> str:
    return (f"SELECT '{table}.{key} unique' AS rule, coalesce({key}::VARCHAR, '') AS key FROM {source} "
            f"GROUP BY {key} HAVING count(*) > 1")


def _strays(source: str, rule: str, key: str, column: str, values: str) -> str:
    return f"SELECT '{rule}' AS rule, coalesce({key}::VARCHAR, '') AS key FROM {source} WHERE {column} NOT IN ({values})"


_QUERIES: dict[str, str] = {
    "load_orphans": " UNION ALL ".join(
        f"""SELECT '{t}s' AS table_name, row_no, 'insert {t} row ' || row_no || ': account does not exist' AS reject_reason FROM p_{t}s
          WHERE reject_reason IS NULL AND (account_id IS NULL OR account_id NOT IN
            (SELECT account_id FROM p_accounts WHERE reject_reason IS NULL AND account_id IS NOT NULL))"""
        for t in ("order", "ticket")),
    "read_sheet": """SELECT row_no, used AS n_cells, array_to_string(list_slice(c, 1, used), '|') AS line FROM (
          SELECT row_no, c, coalesce(list_max(list_transform(range(1, len(c) + 1), lambda i: if(c[i] <> '', i, 0))), 0)::BIGINT AS used
          FROM (SELECT row_no, CASE WHEN row_no % 23 = 0 THEN []
              ELSE list_transform(cells, lambda x, i: CASE WHEN i = 2 AND row_no % 7 = 0 THEN x || ', "x"'
                  WHEN i = 2 AND row_no % 11 = 0 THEN x || chr(10) || x
                  WHEN i = 8 AND row_no % 13 = 0 THEN x || chr(10) || 'B2,"Evil",Growth,Active,,,true,x' || chr(10) || x
                  ELSE x END) END AS c FROM raw_accounts))""",
    "load_abort": _union([f"""SELECT '{t}' AS table_name, 'whole' AS part, if(any_value(reject_reason) IS NULL, count(*), 0)::BIGINT AS rows,
            arg_min(reject_reason, row_no) FILTER (reject_reason IS NOT NULL) AS error FROM p_{t}
        UNION ALL SELECT '{t}', 'clean', count(*), NULL FROM p_{t} WHERE reject_reason IS NULL
        UNION ALL SELECT '{t}', 'empty', 0, '{t} sheet contains no data'""" for t in ("accounts", "orders", "tickets")]),
    "load_accounts": "SELECT * EXCLUDE reject_reason FROM p_accounts WHERE reject_reason IS NULL",
    "load_orders": _as_text(_ORDER_TIMES, """SELECT * EXCLUDE reject_reason REPLACE (shipment_fee_inr::DOUBLE AS shipment_fee_inr)
        FROM p_orders WHERE reject_reason IS NULL"""),
    "load_tickets": _as_text(["created_at", "last_customer_message_at"],
                             "SELECT * EXCLUDE reject_reason FROM p_tickets WHERE reject_reason IS NULL"),
    "load_rejects": _union([f"SELECT row_no, reject_reason FROM p_{t} WHERE reject_reason IS NOT NULL"
                            for t in ("accounts", "orders", "tickets")]),
    "load_counts": _union([f"SELECT '{t}' AS table_name, count(*) AS rows FROM p_{t} WHERE reject_reason IS NULL"
                           for t in ("accounts", "orders", "tickets")]),
    "document_chunk_counts": """SELECT s.document_id, count(c.chunk_index) AS n_chunks
        FROM chunk_source s LEFT JOIN chunks c USING (document_id) GROUP BY s.document_id""",
    "snapshot_gate": """SELECT workbook, marked_lines, CASE WHEN stray IS NOT NULL THEN 'unexpected dataset snapshot: ' || stray
          WHEN marked_lines = 0 THEN 'dataset snapshot not found in README' END AS error,
          stray IS NULL AND marked_lines > 0 AS ok
        FROM (SELECT workbook, count(*) FILTER (contains(line, 'Dataset snapshot')) AS marked_lines,
            arg_min(line, turn) FILTER (contains(line, 'Dataset snapshot') AND NOT contains(line, '2026-08-16 11:00')) AS stray
          FROM (SELECT conv_id AS workbook, turn, CASE
              WHEN turn = 0 AND conv_id % 4 IN (0, 1) THEN 'Dataset snapshot 2026-08-16 11:00 Asia/Kolkata'
              WHEN turn = 1 AND conv_id % 4 IN (1, 2) THEN 'Dataset snapshot: 2026-08-15 11:00 ' || role
              ELSE role || ' ' || turn END AS line FROM conversations) GROUP BY workbook)""",
    "sheet_preview": _union([f"""SELECT '{t}' AS sheet, row_no, array_to_string(cells, '|') AS line FROM (
          SELECT *, row_number() OVER (ORDER BY row_no) AS n FROM raw_{t}) WHERE n <= 6 AND row_no <= 6"""
                             for t in ("accounts", "orders", "tickets")]),
    "dedupe_last": _as_text(["created_at", "last_customer_message_at"], """SELECT * EXCLUDE (reject_reason, n) FROM (
        SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY row_no DESC) AS n FROM p_tickets
        WHERE reject_reason IS NULL) WHERE n = 1"""),
    "upsert_accounts": _upsert("accounts", "account_id", """SELECT *, NULL::VARCHAR AS csm, NULL::VARCHAR AS contract_file,
        NULL::VARCHAR AS notes FROM accounts WHERE status = 'Active'""",
        ["account_name", "plan", "status", "csm", "contract_file", "premium_support", "notes"]),
    "upsert_orders": _UPSERT_ORDERS,
    "upsert_orders_stored": _UPSERT_ORDERS,
    "upsert_tickets": _as_text(["created_at", "last_customer_message_at"], _upsert("tickets", "ticket_id",
        """SELECT *, NULL::VARCHAR AS channel, NULL::VARCHAR AS assigned_to, NULL::TIMESTAMP AS last_customer_message_at,
        NULL::VARCHAR AS historical_resolution FROM tickets WHERE status = 'open'""",
        ["account_id", "created_at", "status", "subject", "description", "channel", "assigned_to",
         "last_customer_message_at", "historical_resolution"],
        created="created_record_at", before="NULL")),
    "upsert_documents": """SELECT filename, title, document_type, status, authority_rank, account_id,
          if(status = 'CURRENT', doc_id, top + row_number() OVER (PARTITION BY status = 'CURRENT' ORDER BY filename)) AS id,
          if(status = 'CURRENT', '2024-01-01 00:00:00.000000', '2024-02-01 00:00:00.000000') AS created_at
        FROM registry, (SELECT max(doc_id) AS top FROM registry WHERE status = 'CURRENT')""",
    "upsert_documents_fields": f"""SELECT filename, strftime(DATE '2024-03-01' + authority_rank::INT, '%Y-%m-%d') AS effective_from,
          if(status = 'DEPRECATED', '2024-12-31', NULL) AS effective_to, '{{"source":"{DOCUMENT_SOURCE}"}}' AS metadata,
          '{DOCUMENT_SOURCE}' AS source FROM registry""",
    "assign_ids": """SELECT filename, (SELECT max(doc_id) FROM registry) + row_number() OVER (ORDER BY filename) AS id
        FROM files WHERE filename NOT IN (SELECT filename FROM registry)""",
    "replace_chunks": """SELECT document_id, chunk_index, content FROM plain_chunks
        WHERE document_id NOT IN (SELECT document_id FROM english)
        UNION ALL SELECT document_id, chunk_index, content FROM short_chunks""",
    "cascade_delete_chunks": """SELECT document_id, chunk_index, strlen(content) AS bytes FROM plain_chunks
        WHERE document_id IN (SELECT document_id FROM doc_text WHERE lang <> 'en')""",
    "store_embeddings": """SELECT vec_id AS chunk_id, if(vec_id % 34 = 0, NULL, 64)::BIGINT AS width,
        if(vec_id % 34 = 0, NULL, round(-embedding[1]::DOUBLE, 6)) AS first_value FROM embeddings""",
    "store_embedding_values": """SELECT chunk_id, slot, round(-e[slot + 1]::DOUBLE, 6) AS value FROM (
        SELECT vec_id AS chunk_id, embedding AS e, unnest(range(0, 64)) AS slot FROM embeddings WHERE vec_id % 34 <> 0)""",
    "store_embedding_errors": """SELECT vec_id AS chunk_id, 'invalid embedding dimension: got 63, expected 64' AS error
        FROM embeddings WHERE vec_id % 34 = 0""",
    "nullable_string": f"SELECT row_no, nullif({_trim('cells[5]')}, '') AS value FROM raw_accounts",
    "parse_local_time": f"""SELECT row_no, cells[3] AS cell, {_ts(_time('cells[3]'))} AS value,
        {_bad_time('cells[3]')} AS is_error FROM raw_tickets WHERE row_no > 1""",
    "parse_bool": f"SELECT row_no, cells[11] AS cell, {_bool('cells[11]')} AS value FROM raw_orders",
    "parse_fee": f"SELECT row_no, cells[9] AS cell, {_stored(_fee('cells[9]'))}::DOUBLE AS value FROM raw_orders",
    "normalize_document_text": f"SELECT document_id, {_clean_text('text')} AS text FROM chunk_source",
    "normalize_match_text": f"SELECT document_id, {_match('text')} AS text FROM chunk_source",
    "chunk_documents": "SELECT document_id, chunk_index, content FROM chunks",
    "phrase_flags": f"""SELECT document_id, contains(t, 'may cancel any booked shipment before pickup with no cancellation fee') AS is_agreement,
        contains(t, 'cannot cancel') AS is_deny, false AS is_policy, contains(t, 'fixed inr 300 service credit') AS is_credit_override
        FROM (SELECT document_id, {_match('content')} AS t FROM policy_docs)""",
    "chunk_metadata_json": """SELECT document_id, chunk_index, if(document_id % 5 = 0, NULL, 'assessment_pdf') AS source,
        if(document_id % 5 = 0, NULL, chunk_index::VARCHAR) AS index_text, document_id % 5 = 0 AS is_bad FROM chunks""",
    "credit_amount": f"""SELECT order_id, round(a, 6) AS amount, {_stored('a')}::DOUBLE AS stored, printf('%.2f', a) AS money
        FROM (SELECT order_id, least(shipment_fee_inr::DOUBLE * 0.1::DOUBLE, 500.0::DOUBLE) AS a FROM shipments)""",
    "pickup_delay": """SELECT request_id, (epoch(requested_at - pickup_window_end) / 60)::BIGINT AS delay_minutes,
        requested_at - pickup_window_end >= INTERVAL 2 HOUR AS past_2h,
        requested_at - pickup_window_end >= INTERVAL 4 HOUR AS past_4h FROM context WHERE order_found""",
    "validate_requests": """SELECT request_id, if(error IS NULL, q, NULL) AS query, if(error IS NULL, a, NULL) AS account_id,
        if(error IS NULL, o, NULL) AS order_id, error
        FROM (SELECT *, CASE WHEN NOT ok AND json_valid('[' || regexp_replace(body, '}\\s+\\{', '},{') || ']')
              THEN 'request body must contain a single JSON object'
            WHEN NOT ok OR json_type(j) <> 'OBJECT' OR coalesce(json_type(j, '$.query'), 'NULL') NOT IN ('VARCHAR', 'NULL')
              THEN 'invalid JSON body'
            WHEN q = '' THEN 'query is required' WHEN a = '' THEN 'account_id is required'
            WHEN o = '' THEN 'order_id is required' END AS error
          FROM (SELECT *, """ + ", ".join(f"{_trim(f'''coalesce(json_extract_string(j, '$.{n}'), '')''')} AS {v}"
                                          for n, v in (("query", "q"), ("account_id", "a"), ("order_id", "o"))) + """
            FROM (SELECT *, json_valid(body) AS ok, if(json_valid(body), body, '{}')::JSON AS j FROM bodies)))""",
    "validate_confirmations": """SELECT seq, if(error IS NULL, c, NULL) AS confirmation_id,
        if(error IS NULL, coalesce(json_extract_string(j, '$.confirm') = 'true', false), NULL) AS confirm, error
        FROM (SELECT *, CASE WHEN NOT ok OR json_type(j, '$.confirm') = 'VARCHAR' THEN 'invalid JSON body'
            WHEN c = '' THEN 'confirmation_id is required' END AS error
          FROM (SELECT *, """ + _trim("coalesce(json_extract_string(j, '$.confirmation_id'), '')") + """ AS c
            FROM (SELECT *, json_valid(body) AS ok, if(json_valid(body), body, '{}')::JSON AS j FROM answer_bodies)))""",
    "cancellation_fee": """SELECT request_id, order_status, CASE WHEN order_status <> 'BOOKED' THEN NULL
          WHEN agree > 0 OR requested_at - booked_at <= INTERVAL 30 MINUTE THEN 0.0::DOUBLE ELSE 250.0::DOUBLE END AS fee
        FROM context WHERE order_found AND account_found""",
    "scan_documents": """SELECT document_id, filename, title, document_type, status, authority_rank, account_id
        FROM files JOIN registry USING (filename) WHERE filename LIKE '%.pdf'""",
    "scan_documents_strict": """SELECT document_id, filename, title, if(title IS NULL, 'unknown document', NULL) AS error
        FROM files LEFT JOIN registry USING (filename) WHERE suffix(filename, '.pdf')""",
    "attach_metadata": """SELECT document_id, filename, title, document_type, status, authority_rank, account_id,
        doc_id IS NOT NULL AS known FROM files LEFT JOIN registry USING (filename)""",
    "assemble_pages": f"""SELECT document, {_clean_text("coalesce(t, '')")} AS text FROM (
        SELECT conv_id AS document, string_agg(if(turn % 7 = 6, NULL, text || chr(10)), '' ORDER BY turn) AS t
        FROM conversations GROUP BY conv_id)""",
    "hash_embedding": "SELECT doc_id, slot, round(weight, 5) AS weight FROM doc_vectors",
    "embed_chunks": "SELECT document_id, chunk_index, slot, round(weight, 5) AS weight FROM digest_vectors",
    "stream_embed": """SELECT document_id, chunk_index, slot, round(weight, 5) AS weight FROM plain_vectors""",
    "embedding_backlog": """SELECT chunk_id, document_id, content FROM chunk_vectors WHERE embedding IS NULL
        ORDER BY chunk_id LIMIT 8""",
    "embed_backlog": """SELECT chunk_id, 64::BIGINT AS width, round(if(embedding IS NULL, 1.0,
        list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS square_sum FROM chunk_vectors""",
    "embed_backlog_values": """SELECT chunk_id, slot, round(weight, 5) AS weight FROM backlog_vectors
        UNION ALL SELECT chunk_id, slot, round(e[slot + 1]::DOUBLE, 5) FROM (
            SELECT chunk_id, embedding AS e, unnest(range(0, 64)) AS slot FROM chunk_vectors WHERE embedding IS NOT NULL)
        WHERE e[slot + 1] > 0""",
    "cosine_topk": f"SELECT query_id, rank, chunk_id, score FROM ({_TOPK})",
    "cosine_topk_many": """SELECT query_id, rank, chunk_id, score FROM (SELECT q.vec_id AS query_id, c.chunk_id, round(score, 6) AS score,
          row_number() OVER (PARTITION BY q.vec_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
        FROM embeddings q, (SELECT *, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE embedding IS NOT NULL) c,
          LATERAL (SELECT list_cosine_similarity(q.embedding::DOUBLE[], c.e) AS score)) WHERE rank <= 5""",
    "source_projection": f"SELECT query_id, rank, document_id, content, score FROM ({_TOPK})",
    "search_documents": """SELECT query_id, rank, document_id, md5(content) AS content_md5, score FROM (
        SELECT query_id, document_id, chunk_index, round(s, 5) AS score,
          row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, document_id, chunk_index) AS rank
        FROM (SELECT q.item_id AS query_id, c.document_id, c.chunk_index, sum(q.weight * c.weight) / any_value(q.size * c.size) AS s
          FROM (SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY item_id)) AS size FROM item_vectors) q
          JOIN (SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY document_id, chunk_index)) AS size FROM text_vectors) c
            USING (slot) GROUP BY q.item_id, c.document_id, c.chunk_index)) JOIN chunks USING (document_id, chunk_index)
        WHERE rank <= 5""",
    "authority_rank": """SELECT account_id, document_type, filename, title, status, authority_rank,
          if(authority_rank = 2, '2024-01-01', NULL) AS effective_from
        FROM (SELECT *, row_number() OVER (PARTITION BY account_id, document_type
            ORDER BY authority_rank, filename) AS n FROM registry WHERE status IN ('CURRENT', 'ACTIVE')) WHERE n = 1""",
    "request_account": """SELECT r.request_id, r.account_id, a.account_name, a.plan, a.status AS account_status, a.premium_support,
        if(a.account_id IS NULL, 'load account: get account ' || r.account_id || ': no rows in result set', NULL) AS load_error
        FROM requests r LEFT JOIN accounts a USING (account_id)""",
    "request_order": f"""SELECT r.request_id, r.order_id, o.status AS order_status, o.carrier,
        o.shipment_fee_inr::DOUBLE AS shipment_fee, o.carrier_fault, o.customer_fault,
        {_ts('o.pickup_window_end')} AS pickup_window_end, o.account_id <> r.account_id AS order_account_mismatch,
        if(o.order_id IS NULL AND r.order_id <> '', 'load order: get order ' || r.order_id || ': no rows in result set', NULL) AS load_error
        FROM requests r LEFT JOIN shipments o ON o.order_id = r.order_id""",
    "request_tickets": f"""SELECT account_id, row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, ticket_id DESC) AS position,
        ticket_id, status, subject, {_ts('created_at')} AS created_at
        FROM tickets WHERE account_id IN (SELECT account_id FROM requests)""",
    "security_ticket": "SELECT account_id, security_ticket_id FROM security",
    "cancellation_evidence": "SELECT request_id, best_score, agreement_count, deny_count, has_policy FROM summary",
    "credit_evidence": "SELECT request_id, has_credit_override FROM summary",
    "evaluate_requests": _EVALUATE,
    "stream_evaluate": _GATED,
    "stream_evaluate_searched": f"SELECT * REPLACE (round(confidence, 6) AS confidence) FROM ({_GATED.replace('decisions', 'r_decisions')})",
    "evaluate_with_retrieval": f"SELECT * REPLACE (round(confidence, 6) AS confidence) FROM ({_EVALUATE.replace('decisions', 'r_decisions')})",
    "request_sources": """SELECT request_id, rank::BIGINT AS rank, document_id, md5(content) AS content_md5, round(score, 6) AS score
        FROM r_requests JOIN r_hits USING (query) JOIN policy_chunks USING (document_id)""",
    "service_credit_decision": _credit_sql(500.0),
    "service_credit_approval": _credit_sql(2000.0),
    "confirmation_gate": """SELECT request_id, ok AS confirmation_required,
        if(ok, sha256(request_id || '|' || action_type || '|' || action_target), NULL) AS confirmation_id
        FROM (SELECT *, error IS NULL AND action_type IS NOT NULL AND confidence >= 0.9 AS ok FROM decisions)""",
    "auto_gate": """SELECT request_id, error IS NULL AND action_type IS NOT NULL AND confidence >= 0.9 AND NOT escalate AS execute
        FROM decisions""",
    "resolution_rate": """SELECT plan, count(*) FILTER (error IS NULL) AS eligible,
        count(*) FILTER (error IS NULL AND NOT escalate AND NOT needs_agent) AS resolved,
        round(count(*) FILTER (error IS NULL AND NOT escalate AND NOT needs_agent)
          / nullif(count(*) FILTER (error IS NULL), 0), 6) AS rate FROM decisions GROUP BY plan""",
    "resolution_rate_daily": _DAILY_RATE,
    "stream_resolution_rate": _DAILY_RATE,
    "apply_action_sequence": _OUTCOMES,
    "stream_apply": _OUTCOMES,
    "apply_cancel": _typed("CANCEL_ORDER"),
    "apply_return": _typed("RETURN_TO_ORIGIN"),
    "apply_escalate": _typed("ESCALATE"),
    "apply_credit": _typed("SERVICE_CREDIT"),
    "apply_credit_approval": _typed("SERVICE_CREDIT_APPROVAL"),
    "action_errors": "SELECT seq, action_type, target_id, refused AS error FROM checked WHERE refused IS NOT NULL",
    "action_target_state": """SELECT seq, action_type, target_id, if(early_error IS NULL, account_id, NULL) AS account_id,
        if(early_error IS NULL, first_status, NULL) AS target_status, early_error AS error FROM states""",
    "orders_after_actions": f"""SELECT o.order_id, CASE c.action_type WHEN 'CANCEL_ORDER' THEN 'CANCELLED'
          WHEN 'RETURN_TO_ORIGIN' THEN 'RETURN_TO_ORIGIN' ELSE o.status END AS status,
        if(c.action_type = 'CANCEL_ORDER', {_ts('c.acted_at')}, NULL) AS cancellation_requested_at,
        coalesce({_ts('c.acted_at')}, '2024-01-01 00:00:00.000000') AS updated_at
        FROM shipments o LEFT JOIN (SELECT * FROM outcomes WHERE outcome = 'executed'
          AND action_type IN ('CANCEL_ORDER', 'RETURN_TO_ORIGIN')) c ON c.target_id = o.order_id""",
    "new_escalations": f"""SELECT target_id AS ticket_id, account_id, reason, 'P1' AS priority, 'created' AS status,
        'agent' AS requested_by, {_ts('acted_at')} AS created_at
        FROM outcomes WHERE outcome = 'executed' AND action_type = 'ESCALATE'""",
    "new_credits": f"""SELECT target_id AS order_id, account_id, {_stored('amount')}::DOUBLE AS amount_inr, reason,
        if(action_type = 'SERVICE_CREDIT', 'ISSUED', 'PENDING_APPROVAL') AS status, 'agent' AS requested_by,
        if(action_type = 'SERVICE_CREDIT', {_ts('acted_at')}, NULL) AS issued_at, {_ts('acted_at')} AS created_at
        FROM outcomes WHERE outcome = 'executed' AND action_type LIKE 'SERVICE%'""",
    "active_escalation": """SELECT ticket_id, account_id FROM tickets
        WHERE ticket_id IN (SELECT ticket_id FROM escalations0 WHERE status = 'created')""",
    "active_credit": """SELECT order_id, status FROM shipments
        WHERE order_id IN (SELECT order_id FROM credits0 WHERE status <> 'REJECTED')""",
    "append_audit": _AUDIT,
    "append_audit_published": _AUDIT,
    "latest_audit": f"""SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY target_id
        ORDER BY created_at DESC, id DESC) AS n FROM ({_AUDIT})) WHERE n = 1""",
    "audit_summary": "SELECT action_type, previous_status, new_status, count(*) AS n FROM audit GROUP BY ALL",
    "latest_escalation": f"""SELECT id, ticket_id, account_id, reason, priority, status, requested_by, {_ts('created_at')} AS created_at
        FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC, id DESC) AS n FROM escalations0) WHERE n = 1""",
    "confirmation_outcomes": f"""SELECT confirmation_id, seq, {_ts('answered_at')} AS answered_at,
        if(won, if(confirm, 'executed', 'rejected'), NULL) AS status,
        if(won, NULL, 'confirmation not found or expired') AS error, if(won AND confirm, action_type, NULL) AS action_type,
        if(won AND confirm, target_id, NULL) AS target_id, if(won AND confirm, reason, NULL) AS reason
        FROM (SELECT *, met AND nth = 1 AND in_time AS won FROM judged)""",
    "match_confirmations": f"""SELECT p.confirmation_id, {_ts('p.created_at')} AS created_at, j.seq AS answer_seq,
        {_ts('j.answered_at')} AS answered_at,
        CASE WHEN NOT coalesce(j.in_time, false) THEN 'expired' WHEN j.confirm THEN 'confirmed' ELSE 'rejected' END AS state
        FROM proposals p LEFT JOIN (SELECT * FROM judged WHERE met AND nth = 1) j USING (confirmation_id)""",
    "stream_confirmations": """SELECT confirmation_id, seq, if(good, if(confirm, 'executed', 'rejected'), NULL) AS status,
          if(good, NULL, 'confirmation not found or expired') AS error
        FROM (SELECT *, coalesce(met AND in_time, false) AS good FROM judged) WHERE NOT good OR nth = 1
        UNION ALL SELECT confirmation_id, NULL, 'expired', NULL FROM proposals
        WHERE confirmation_id NOT IN (SELECT confirmation_id FROM judged WHERE met AND in_time)""",
    "check_unique": _union([
        _repeats("p_accounts", "accounts", "account_id"), _repeats("p_orders", "orders", "order_id"),
        _repeats("p_tickets", "tickets", "ticket_id"),
        *[_repeats(f"i_{t}", t, c) for t, c in (
            ("documents", "id"), ("documents", "filename"), ("document_chunks", "id"), ("escalations", "id"),
            ("audit_logs", "id"), ("service_credits", "id"))],
        """SELECT 'document_chunks.document_id+chunk_index unique' AS rule, concat_ws('|', document_id, chunk_index) AS key
          FROM i_document_chunks GROUP BY document_id, chunk_index HAVING count(*) > 1"""]),
    "check_not_null": _union(
        _nulls("p_accounts", "accounts", "account_id", ["account_id", "account_name", "plan", "status", "premium_support"])
        + _nulls("p_orders", "orders", "order_id", ["order_id", "account_id", "carrier", "status", "shipment_fee_inr",
                                                   "carrier_fault", "customer_fault"])
        + _nulls("p_tickets", "tickets", "ticket_id", ["ticket_id", "account_id", "created_at", "status", "subject", "description"])
        + [x for t, key in (("documents", "filename"), ("document_chunks", "id"), ("escalations", "id"), ("audit_logs", "id"),
                            ("service_credits", "id")) for x in _nulls(f"i_{t}", t, key, list(FAULTS[t][1]))]),
    "check_foreign_keys": _union([
        f"""SELECT '{t}.{c} references {pt}' AS rule, {k}::VARCHAR AS key FROM {s} WHERE {c} IS NOT NULL
          AND {c} NOT IN (SELECT {pc} FROM {p} WHERE {pc} IS NOT NULL)"""
        for s, t, c, k, p, pc, pt in _FOREIGN_KEYS]),
    "check_enums": _union([
        _strays("p_accounts", "accounts.plan allowed", "account_id", "plan", "'Standard', 'Growth', 'Enterprise'"),
        _strays("p_orders", "orders.status allowed", "order_id", "status",
                "'DRAFT', 'BOOKED', 'PICKED_UP', 'RETURN_TO_ORIGIN', 'DELIVERED', 'CANCELLED'"),
        _strays("i_escalations", "escalations.priority allowed", "id", "priority", "'P1', 'P2', 'P3'"),
        _strays("i_escalations", "escalations.status allowed", "id", "status", "'pending', 'confirmed', 'created', 'cancelled'"),
        _strays("i_service_credits", "service_credits.status allowed", "id", "status",
                "'PENDING_APPROVAL', 'APPROVED', 'ISSUED', 'REJECTED'")]),
    "check_active_unique": """SELECT 'one created escalation per ticket' AS rule, ticket_id AS key FROM escalations0 WHERE status = 'created'
        UNION ALL SELECT 'one active credit per order', order_id FROM credits0 WHERE status <> 'REJECTED'""",
    "check_amount": """SELECT 'service_credits.amount_inr positive' AS rule, id::VARCHAR AS key FROM credits0 WHERE amount_inr - 40 <= 0""",
    "check_vector_width": """SELECT 'embedding has 64 values' AS rule, vec_id::VARCHAR AS key FROM embeddings WHERE vec_id % 34 = 0""",
}
_QUERIES["stream_replies"] = _QUERIES["confirmation_outcomes"]  # a stream of the same rows
_CTES |= _hashed("plain_vectors", "plain_chunks", "document_id, chunk_index", "content")

ORACLES: dict[str, str] = {name: _with(sql) for name, sql in _QUERIES.items()}
