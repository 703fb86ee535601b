"""The rule data: small fixed tables, as DataFrames for broadcast joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values, all of them: ids, weights, preferences and word lists.

#: id | family | severity | oracle | techniques in order of preference | requirements
SCENARIOS = """
IDEM-REPLAY | idempotency | critical | specification | faultInjection unit | key injectable
IDEM-PAYLOAD-MISMATCH | idempotency | high | specification | faultInjection unit | key injectable
IDEM-CONCURRENT | idempotency | critical | specification | concurrency narrowIntegration | key injectable
IDEM-CRASH-AT-STEP | idempotency | critical | specification | faultInjection | key injectable
TIMEOUT-UNKNOWN-OUTCOME | failure | critical | specification | faultInjection | injectable seam:http seam:queue
ORPHANED-AUTHORIZATION | failure | critical | invariant | faultInjection | injectable tx
UNCLASSIFIED-ERROR-NOT-RETRIED | failure | high | specification | table faultInjection | injectable
CONSERVATION-UNDER-CONCURRENCY | consistency | critical | invariant | narrowIntegration property concurrency | balance money database
LOST-UPDATE | consistency | critical | invariant | narrowIntegration | balance money database seam:db
DOUBLE-ENTRY-SUMS-TO-ZERO | consistency | critical | invariant | property table | transfer money
LEDGER-OUTSIDE-CALLER-TRANSACTION | boundary | critical | invariant | narrowIntegration | transfer tx database
NETWORK-CALL-INSIDE-TRANSACTION | boundary | high | specification | faultInjection unit | tx injectable seam:http seam:queue
ILLEGAL-TRANSITION-REFUSED | state | high | specification | stateMachine table | machine
FINAL-STATE-IS-FINAL | state | critical | specification | stateMachine table | machine
FAILURE-IS-NOT-TERMINAL | state | high | specification | stateMachine faultInjection | machine injectable
WEBHOOK-ORDER-INDEPENDENT | ordering | high | metamorphic | metamorphic property | entries machine
AT-LEAST-ONCE-DELIVERY-IS-SAFE | ordering | high | invariant | metamorphic faultInjection | injectable seam:queue
MONEY-ROUND-TRIP-EXACT | money | critical | invariant | fuzz property | money
MINOR-UNIT-CONVERSION | money | high | specification | table | money
SPLIT-SUMS-TO-TOTAL | money | high | invariant | property table | money
CURRENCY-MIXING-REFUSED | money | high | invariant | table property | money
RECONCILER-IS-IDEMPOTENT | consistency | high | invariant | narrowIntegration faultInjection | entries
ASYNC-RESPONSE-BEFORE-DURABILITY | boundary | critical | invariant | faultInjection concurrency | goroutine injectable
BALANCE-NEVER-NEGATIVE | money | critical | invariant | concurrency narrowIntegration | money balance tx database
TRANSFER-IS-ATOMIC | consistency | critical | invariant | faultInjection narrowIntegration | transfer tx injectable
DEADLOCK-IS-RECOVERED | consistency | high | invariant | concurrency narrowIntegration | tx database transfer
TENANT-ROWS-DONT-LEAK | consistency | critical | invariant | narrowIntegration | tenant database
SELF-TRANSFER-REFUSED | money | high | invariant | table unit | transfer
BALANCE-LIMIT-ENFORCED | boundary | high | specification | concurrency narrowIntegration | money balance database
WALLET-STATUS-GATES-MOVEMENT | state | high | specification | table stateMachine | machine money
READ-MODIFY-WRITE-NEEDS-A-LOCK | consistency | critical | invariant | concurrency narrowIntegration | database tx write:update_in_place
APPEND-ONLY-HISTORY-IS-IMMUTABLE | consistency | high | invariant | narrowIntegration property | database write:insert_only
HASH-CHAIN-CATCHES-TAMPERING | consistency | high | metamorphic | metamorphic unit | hash_chain
UPSERT-HIDES-A-SECOND-EFFECT | idempotency | critical | specification | faultInjection narrowIntegration | database injectable write:upsert
"""
MEDIUM_TECHNIQUES = ["narrowIntegration", "endToEnd"]

#: feature | area | evidence, + holds when true and - when false | scenarios that it informs
FEATURES = """
money.amounts_stay_exact | money | -MONEY-ROUND-TRIP-EXACT.representation | MONEY-ROUND-TRIP-EXACT MINOR-UNIT-CONVERSION SPLIT-SUMS-TO-TOTAL
money.one_currency_per_transaction | money | -CURRENCY-MIXING-REFUSED.can_mix -ledger.multi_currency_legs | CURRENCY-MIXING-REFUSED DOUBLE-ENTRY-SUMS-TO-ZERO
money.balance_never_negative | money | -BALANCE-NEVER-NEGATIVE.may_go_negative -market.negative_seller | BALANCE-NEVER-NEGATIVE LOST-UPDATE
money.balance_guard_is_atomic | money | +BALANCE-NEVER-NEGATIVE.guard_is_atomic +BALANCE-LIMIT-ENFORCED.checked_atomically -LOST-UPDATE.locking | BALANCE-NEVER-NEGATIVE BALANCE-LIMIT-ENFORCED LOST-UPDATE
money.balance_has_one_writer | money | -wallet.other_writers | CONSERVATION-UNDER-CONCURRENCY LOST-UPDATE BALANCE-NEVER-NEGATIVE
money.ledger_rule_outside_go | money | +DOUBLE-ENTRY-SUMS-TO-ZERO.enforced_outside_go | DOUBLE-ENTRY-SUMS-TO-ZERO
money.captured_equals_authorized | money | -authcap.partial -authcap.overcapture | ORPHANED-AUTHORIZATION
money.used_whole_or_not_at_all | money | -voucher.partial -escrow.partial_release | FINAL-STATE-IS-FINAL
seams.timeout_resolved_by_reading | seams | +TIMEOUT-UNKNOWN-OUTCOME.requery -TIMEOUT-UNKNOWN-OUTCOME.requery_resubmits | TIMEOUT-UNKNOWN-OUTCOME IDEM-CRASH-AT-STEP UNCLASSIFIED-ERROR-NOT-RETRIED
seams.unknown_errors_are_final | seams | -UNCLASSIFIED-ERROR-NOT-RETRIED.default | UNCLASSIFIED-ERROR-NOT-RETRIED TIMEOUT-UNKNOWN-OUTCOME
seams.redelivery_is_harmless | seams | +AT-LEAST-ONCE-DELIVERY-IS-SAFE.duplicate_message | AT-LEAST-ONCE-DELIVERY-IS-SAFE WEBHOOK-ORDER-INDEPENDENT IDEM-REPLAY
seams.callback_order_does_not_matter | seams | +WEBHOOK-ORDER-INDEPENDENT.out_of_order | WEBHOOK-ORDER-INDEPENDENT FINAL-STATE-IS-FINAL
seams.acts_only_on_settled_money | seams | -refund.can_fail_late -escrow.reversible_inbound -market.transfer_before_settlement | FINAL-STATE-IS-FINAL FAILURE-IS-NOT-TERMINAL
flow.money_moves_in_one_transaction | flow | +TRANSFER-IS-ATOMIC.same_transaction +LEDGER-OUTSIDE-CALLER-TRANSACTION.shares_tx | TRANSFER-IS-ATOMIC LEDGER-OUTSIDE-CALLER-TRANSACTION
flow.saved_before_reply | flow | -ASYNC-RESPONSE-BEFORE-DURABILITY.acks_early | ASYNC-RESPONSE-BEFORE-DURABILITY IDEM-CRASH-AT-STEP
flow.illegal_transitions_refused | flow | +ILLEGAL-TRANSITION-REFUSED.enforced_where | ILLEGAL-TRANSITION-REFUSED FINAL-STATE-IS-FINAL WEBHOOK-ORDER-INDEPENDENT
flow.failed_is_terminal | flow | +oneshot.failure_terminal | FAILURE-IS-NOT-TERMINAL FINAL-STATE-IS-FINAL
flow.inactive_blocks_both_ways | flow | +WALLET-STATUS-GATES-MOVEMENT.blocks_credits | WALLET-STATUS-GATES-MOVEMENT
flow.self_transfer_refused | flow | +SELF-TRANSFER-REFUSED.is_refused | SELF-TRANSFER-REFUSED TRANSFER-IS-ATOMIC
flow.jobs_safe_to_rerun | flow | -RECONCILER-IS-IDEMPOTENT.rerun +recon.rerun_safe +usage.rerun_safe | RECONCILER-IS-IDEMPOTENT
entity.same_key_runs_once | entity | +IDEM-CONCURRENT.exactly_one | IDEM-CONCURRENT IDEM-REPLAY IDEM-CRASH-AT-STEP UPSERT-HIDES-A-SECOND-EFFECT
entity.repeat_gets_first_result | entity | +IDEM-REPLAY.stores_result | IDEM-REPLAY IDEM-CONCURRENT IDEM-PAYLOAD-MISMATCH
entity.key_bound_to_request | entity | +IDEM-PAYLOAD-MISMATCH.rejects | IDEM-PAYLOAD-MISMATCH IDEM-REPLAY
entity.failure_is_replayed | entity | +IDEM-REPLAY.replays_failures | IDEM-REPLAY FAILURE-IS-NOT-TERMINAL
"""

#: axis | kind | scenarios
KIND_SCENARIOS = """
spine | double_entry | DOUBLE-ENTRY-SUMS-TO-ZERO CONSERVATION-UNDER-CONCURRENCY LEDGER-OUTSIDE-CALLER-TRANSACTION LOST-UPDATE
spine | wallet | CONSERVATION-UNDER-CONCURRENCY LOST-UPDATE MONEY-ROUND-TRIP-EXACT BALANCE-NEVER-NEGATIVE TRANSFER-IS-ATOMIC SELF-TRANSFER-REFUSED BALANCE-LIMIT-ENFORCED WALLET-STATUS-GATES-MOVEMENT
spine | stateless | TIMEOUT-UNKNOWN-OUTCOME ASYNC-RESPONSE-BEFORE-DURABILITY UNCLASSIFIED-ERROR-NOT-RETRIED
motion | one_shot | IDEM-REPLAY IDEM-CONCURRENT IDEM-CRASH-AT-STEP
motion | auth_capture | ORPHANED-AUTHORIZATION FINAL-STATE-IS-FINAL ILLEGAL-TRANSITION-REFUSED
motion | subscription | IDEM-REPLAY IDEM-PAYLOAD-MISMATCH
motion | usage_billing | MONEY-ROUND-TRIP-EXACT SPLIT-SUMS-TO-TOTAL
motion | topup | TIMEOUT-UNKNOWN-OUTCOME IDEM-REPLAY FAILURE-IS-NOT-TERMINAL
motion | voucher | IDEM-REPLAY FINAL-STATE-IS-FINAL
motion | payout | TIMEOUT-UNKNOWN-OUTCOME FINAL-STATE-IS-FINAL IDEM-CRASH-AT-STEP
motion | marketplace | SPLIT-SUMS-TO-TOTAL CONSERVATION-UNDER-CONCURRENCY
motion | escrow | FINAL-STATE-IS-FINAL ILLEGAL-TRANSITION-REFUSED
motion | installments | SPLIT-SUMS-TO-TOTAL IDEM-REPLAY
overlay | refund_reversal | FINAL-STATE-IS-FINAL FAILURE-IS-NOT-TERMINAL MONEY-ROUND-TRIP-EXACT
overlay | reconciliation | RECONCILER-IS-IDEMPOTENT AT-LEAST-ONCE-DELIVERY-IS-SAFE WEBHOOK-ORDER-INDEPENDENT
overlay | fx_conversion | CURRENCY-MIXING-REFUSED MINOR-UNIT-CONVERSION MONEY-ROUND-TRIP-EXACT
"""
#: axis | kind | overlays that are expected with it
EXPECTED_OVERLAYS = """
motion | topup | refund_reversal reconciliation
motion | one_shot | refund_reversal
motion | auth_capture | refund_reversal
motion | payout | reconciliation
motion | marketplace | refund_reversal
spine | double_entry | reconciliation
"""
#: axis | kind | weight | a test: any of the tables, columns, symbols or states, with & for several and ! for none
SIGNALS = """
spine | double_entry | 3 | table: entries postings ledger_entries journal_entries book_entries
spine | double_entry | 3 | table: accounts ledger_accounts books & column: normal_side account_type side direction
spine | double_entry | 3 | symbol: assertbalanced postentries posttransaction balancedlegs
spine | double_entry | 2 | column: debit credit debit_amount credit_amount
spine | wallet | 3 | column: balance balance_cents credits points wallet_balance available_balance blocked_balance pending_balance
spine | wallet | 2 | table: wallets wallet balances user_balances
spine | wallet | 2 | symbol: deductbalance addbalance creditwallet debitwallet updatebalance chargewallet coretransfer singletransfer deposit withdraw topup reclaim ensurewallet
motion | topup | 4 | column: phone phone_number msisdn mobile meter_number decoder_number smartcard subscriber beneficiary sim sim_type
motion | topup | 2 | column: operator_id biller_code product_code item_code bundle denomination plan_id charge_type purchase_type service_code package product
motion | topup | 2 | symbol: recharge topup airtime getstatus get_status requery inquiry
motion | topup | 3 | column: provider_trace_id rrn stan tid provider_ref external_ref & symbol: status inquiry retry requery
motion | topup | 2 | column: price amount & column: base_price discount commission markup face_value delivered_amount payment_price
motion | auth_capture | 4 | column: captured_at authorized_amount captured_amount amount_captured authorization_id auth_code
motion | auth_capture | 2 | symbol: capture void authorize & !symbol: capturelog
motion | subscription | 4 | table: subscriptions plans invoices or column: billing_cycle_anchor current_period_end trial_end
motion | usage_billing | 4 | table: usage_events meter_events usage_records or column: metered usage_quantity
motion | voucher | 4 | table: vouchers gift_cards codes pins or column: voucher_code redeemed_at initial_value
motion | payout | 4 | table: payouts disbursements withdrawals transfers_out or symbol: payout disburse withdraw
motion | marketplace | 3 | table: splits seller_transfers sub_merchants
motion | marketplace | 3 | column: platform_fee application_fee seller_amount
motion | marketplace | 2 | column: seller_id merchant_id vendor_id
motion | escrow | 4 | table: holds escrows reservations or column: held_amount pending_balance reserved_amount hold_expires_at
motion | installments | 4 | table: installments instalments schedules repayments or column: installment_number due_date principal interest
overlay | refund_reversal | 4 | symbol: refund reverse reversal chargeback dispute cancel or state: REFUND REFUNDED REVERSED CHARGEBACK or table: refunds reversals disputes
overlay | reconciliation | 4 | symbol: reconcile reconciliation settlement settle or table: settlements reconciliations or column: retry_config retry_cron_input inquiry_cron_input or symbol: cron task job sweep & symbol: status retry inquiry
overlay | fx_conversion | 3 | column: currency fx_rate exchange_rate base_currency target_currency & currencies
"""
#: topic | words
DOC_TOPICS = """
money movement | settle, settlement, payout, disburse, transfer, capture, authoriz, authoris
reversal | refund, reverse, reversal, chargeback, dispute, recall, cancel
lifecycle | status, state machine, lifecycle, transition, pending, final
idempotency | idempot, duplicate, dedup, retry, replay
ledger | ledger, double entry, double-entry, journal, balance, debit, credit
messaging | kafka, topic, partition, consumer, webhook, callback, queue
reconciliation | reconcil, coherence, catch-up, catchup, mismatch
"""
#: path of an answer's field | use
FIELDS = """
moneyModel.money.type | live
moneyModel.money.amount_field | live
moneyModel.money.representation | live
moneyModel.money.currency | live
moneyModel.money.proof | live
moneyModel.transfer_func | live
moneyModel.balance_func | live
moneyModel.idempotency.key_field | live
moneyModel.idempotency.uniqueness | live
moneyModel.idempotency.proof | live
mainEntity.main_entity.struct | live
mainEntity.main_entity.proof | live
mainEntity.idempotency_key.field | live
mainEntity.idempotency_key.proof | validation
mainEntity.idempotency_key.supplied_by | live
mainEntity.idempotency_key.read_before_acting | live
mainEntity.other_identifiers | validation
mainEntity.no_key_reason | validation
stateRoles.roles | live
stateRoles.exceptions | live
externalEffect.changes_external_state | live
externalEffect.reversible_by_rollback | live
externalEffect.outcome_observable | live
externalEffect.accepts_dedup_key | live
externalEffect.moves_money | live
questions.verdict | live
questions.info | live
"""


def rows(text: str) -> list[list[str]]:
    return [[p.strip() for p in line.split("|")] for line in text.strip().splitlines()]


def scenarios(spark: SparkSession) -> DataFrame:
    data = [(k, i, f, s, o, t.split(), [x for x in r.split() if ":" not in x], [x[5:] for x in r.split() if x.startswith("seam:")], [x[6:] for x in r.split() if x.startswith("write:")]) for k, (i, f, s, o, t, r) in enumerate(rows(SCENARIOS))]
    return spark.createDataFrame(data, "ord int, scenario string, family string, severity string, oracle string, techniques array<string>, requires array<string>, seam_kinds array<string>, write_patterns array<string>")


def seam_pools() -> list[str]:
    """The sets of seam kinds that scenarios name, each as its kinds in order."""
    named = [" ".join(x[5:] for x in r.split() if x.startswith("seam:")) for *_, r in rows(SCENARIOS)]
    return list(dict.fromkeys(x for x in named if x))


def evidence(spark: SparkSession) -> DataFrame:
    areas = list(dict.fromkeys(a for _, a, _, _ in rows(FEATURES)))
    data = [(k, areas.index(a), f, a, e[1:], e[0] == "+", i.split()) for k, (f, a, es, i) in enumerate(rows(FEATURES)) for e in es.split()]
    return spark.createDataFrame(data, "ord int, area_ord int, feature string, area string, question string, holds_when boolean, informs array<string>")


def kind_scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s) for _, k, ss in rows(KIND_SCENARIOS) for s in ss.split()], "kind string, scenario string")


def expected_overlays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s) for _, k, ss in rows(EXPECTED_OVERLAYS) for s in ss.split()], "kind string, overlay string")


def doc_topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, w) for t, ws in rows(DOC_TOPICS) for w in ws.split(", ")], "topic string, word string")


def answer_fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows(FIELDS)], "path string, use string")
