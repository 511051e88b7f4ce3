"""Struct types of the event log and its payloads."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B, _D, _A = T.StringType(), T.LongType(), T.BooleanType(), T.DecimalType(38, 9), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


#: The envelope that all events share; the payload stays JSON until a kind is asked for.
EVENT = _struct(event_id=_S, source=_S, canonicality=_S, slot=_L, parent_slot=_L, signature=_S, transaction_index=_L, account_write_version=_L, received_at=T.TimestampType(), observed_at_monotonic_ns=_L, source_latency_ms=_L, decode_confidence=_D, data_quality_flags=_A, sequence_number=_L, kind=_S, payload=_S)

_RESERVES = _struct(real_quote=_D, real_token=_D, virtual_quote=_D, virtual_token=_D)
_TRADE = dict(mint=_S, wallet=_S, quote=_D, tokens=_D, price_before=_D, price_after=_D, reserves_before=_RESERVES, reserves_after=_RESERVES, compute_unit_limit=_L, compute_unit_price=_L, priority_fee=_L, base_fee=_L, tip=_L, is_creator=_B, status=_S)
PAYLOADS: dict[str, T.StructType] = {
    "token_created": _struct(mint=_S, quote_mint=_S, creator_wallet=_S, payer=_S, bonding_curve_account=_S, name=_S, symbol=_S, uri=_S, token_program=_S, create_instruction_variant=_S, same_transaction_buys=_L, same_slot_buys=_L, fee_recipients=_A),
    "buy": _struct(**_TRADE),
    "sell": _struct(**_TRADE),
    "curve_update": _struct(mint=_S, account=_S, real_quote=_D, real_token=_D, virtual_quote=_D, virtual_token=_D, price=_D, progress=_D, market_cap=_D, account_write_version=_L),
    "holder_update": _struct(mint=_S, owner_wallet=_S, token_account=_S, old_balance=_D, new_balance=_D, delta=_D, token_decimals=_L, confidence=_D),
    "wallet_funding": _struct(wallet=_S, funder=_S, signature=_S, amount=_D, slot=_L),
    "observed_tx": _struct(signature=_S, program_ids=_A, accounts=_A, compute_units=_L, failed=_B),
    "data_gap": _struct(gap_type=_S, source=_S, severity=_S, start_slot=_L, end_slot=_L, affected_tokens=_A, trade_allowed=_B, recovery_action=_S),
    "decision": _struct(mint=_S, decision=_S, strategy=_S, snapshot_hash=_S, reason_codes=_A, scores=T.MapType(_S, T.DoubleType())),
    "fill": _struct(mint=_S, side=_S, position_id=_S, filled_size=_D, fill_price=_D, notional=_D, fees=_D, landing_time=T.TimestampType(), failure_reason=_S),
}
