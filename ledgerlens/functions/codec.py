"""Scalars over addresses, hex text, epochs and scripts."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bech32 character set, its generator words and the two accepted checksums.
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32_SUMS = (1, 0x2BC830A3)
#: Hash type bytes of a serialised script, and the personalisation of its hash.
HASH_TYPES = {"data": 0, "type": 1, "data1": 2, "data2": 4}
PERSON = b"ckb-default-hash"

#: Registered scripts by code hash and hash type.
SCRIPTS = {
    ("0x9bd7e06f3ecf4be0f2fcd2188b23f1b9fcc88e5d4b65a8637b17723bbda3cce8", "type"): "SECP256K1_BLAKE160",
    ("0x5c5069eb0857efc65e1bca0c07df34c31663b3622fd3876c876320fc9634e2a8", "type"): "SECP256K1_MULTISIG",
    ("0x82d76d1b75fe2fd9a27dfbaa65a039221a380d76c926f378d3f81cf3e7e13f2e", "type"): "NERVOS_DAO",
    ("0x00000000000000000000000000000000000000000000000000545950455f4944", "type"): "TYPE_ID",
    ("0x50bd8d6680b8b9cf98b73f3c08faf8b2a21914311954118ad6609be6e78a1b95", "data1"): "XUDT",
}


def script_family(code_hash: Column, hash_type: Column) -> Column:
    """The registered family of a script, by both its code hash and its hash type, or UNKNOWN."""
    known = F.create_map(*[F.lit(x) for (code, kind), family in SCRIPTS.items() for x in (f"{code}/{kind}", family)])
    return F.coalesce(F.element_at(known, F.concat(code_hash, F.lit("/"), hash_type)), F.lit("UNKNOWN"))


def family_or_digest(code_hash: Column, hash_type: Column, digest: Column, target: Column | None = None) -> Column:
    """TARGET for a script of the wallet itself, else its registered family, else its digest, else UNKNOWN."""
    family = script_family(code_hash, hash_type)
    named = F.when(family != "UNKNOWN", family).otherwise(F.coalesce(digest, F.lit("UNKNOWN")))
    return named if target is None else F.when(F.coalesce(target, F.lit(False)), "TARGET").otherwise(named)


def epoch_seconds(v: Column) -> Column:
    """Seconds of an epoch given in seconds or milliseconds."""
    return F.when(v > 100_000_000_000, F.floor(v / 1000)).otherwise(v).cast("bigint")


def to_int(text: Column) -> Column:
    """Decimal text cut towards zero, or NULL."""
    return F.expr("cast(try_cast(`{0}` as decimal(38,9)) as bigint)".format(text)) if isinstance(text, str) else text.try_cast("decimal(38,9)").try_cast("bigint")


def hex_int(text: Column) -> Column:
    """0x-prefixed hex text of at most 16 digits as DECIMAL(20,0), or NULL."""
    digits = F.regexp_extract(text, "^0[xX]([0-9a-fA-F]{1,16})$", 1)
    return F.when(F.length(digits) > 0, F.conv(F.nullif(digits, F.lit("")), 16, 10).cast("decimal(20,0)"))


def u128(hex_text: Column) -> tuple[Column, Column]:
    """(high, low) halves as DECIMAL(20,0) of a little-endian 16-byte amount; NULL if fewer than 32 hex digits lead."""
    digits = F.when(F.startswith(hex_text, F.lit("0x")), hex_text.substr(F.lit(3), F.lit(32))).otherwise(hex_text.substr(F.lit(1), F.lit(32)))
    number = lambda d, a: F.conv(F.concat(*[F.substring(d, 2 * i + 1, 2) for i in range(a + 7, a - 1, -1)]), 16, 10).cast("decimal(20,0)")
    # a lambda's variable is computed once a row, however many pairs are cut from it
    half = lambda a: F.get(F.transform(F.array(digits), lambda d: F.when(d.rlike("^[0-9a-fA-F]{32}$"), number(d, a))), F.lit(0))
    return half(8), half(0)


def decode_status(kind: Column, hex_text: Column) -> Column:
    """Status of a typed amount: METADATA_MISMATCH, MISSING_16_BYTE_AMOUNT, INVALID_AMOUNT_ENCODING or DECODED."""
    digits = F.lower(F.regexp_replace(F.coalesce(hex_text, F.lit("")), "^0x", ""))
    return (
        F.when(~F.coalesce(kind, F.lit(False)), "METADATA_MISMATCH")
        .when(F.length(digits) < 32, "MISSING_16_BYTE_AMOUNT")
        .when(~digits.rlike("^[0-9a-f]{32}"), "INVALID_AMOUNT_ENCODING")
        .otherwise("DECODED")
    )


def valid_address(address: Column, prefix: str = "ckb") -> Column:
    """Whether a lower-case bech32 or bech32m address has the prefix and a valid checksum."""
    data = F.regexp_extract(address, f"^{prefix}1([{BECH32}]{{6,}})$", 1)
    head = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    values = F.concat(F.array(*map(F.lit, head)), F.transform(F.filter(F.split(data, ""), lambda c: c != ""), lambda c: F.instr(F.lit(BECH32), c) - 1))

    def step(state: Column, v: Column) -> Column:
        top = F.shiftright(state, 25)
        made = F.shiftleft(state.bitwiseAND(F.lit(0x1FFFFFF)), 5).bitwiseXOR(v.cast("bigint"))
        for i, word in enumerate(BECH32_GENERATOR):
            made = made.bitwiseXOR(F.when(F.shiftright(top, i).bitwiseAND(F.lit(1).cast("bigint")) == 1, F.lit(word).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return made

    total = F.aggregate(values, F.lit(1).cast("bigint"), step)
    return F.coalesce((F.length(data) >= 6) & (F.length(address) >= 7) & total.isin(*BECH32_SUMS), F.lit(False))


def plausible_address(address: Column) -> Column:
    return F.coalesce(address.rlike("^ckb1[!-~]*$"), F.lit(False))


def _script_hash(code_hash: str | None, hash_type: str | None, args: str | None) -> str | None:
    try:
        code, tail = bytes.fromhex((code_hash or "").removeprefix("0x")), bytes.fromhex((args or "0x").removeprefix("0x"))
        kind = HASH_TYPES[hash_type or ""]
    except (ValueError, KeyError):
        return None
    if len(code) != 32:
        return None
    word = lambda n: n.to_bytes(4, "little")
    body = code + bytes([kind]) + word(len(tail)) + tail
    packed = word(16 + len(body)) + word(16) + word(48) + word(49) + body
    return "0x" + hashlib.blake2b(packed, digest_size=32, person=PERSON).hexdigest()


def _script_hashes(code_hash: pd.Series, hash_type: pd.Series, args: pd.Series) -> pd.Series:
    return pd.Series([_script_hash(*x) for x in zip(code_hash, hash_type, args, strict=True)], dtype=object)


def script_hash(code_hash: Column, hash_type: Column, args: Column) -> Column:
    """BLAKE2b hash of serialised scripts; apply it to distinct scripts only."""
    return F.pandas_udf(_script_hashes, "string")(code_hash, hash_type, args)


def sampling_stratum(n: Column) -> Column:
    """Stratum of a lifetime transaction count."""
    made = F.lit("5000+")
    for low, high in reversed(((1, 10), (11, 50), (51, 200), (201, 500), (501, 1000), (1001, 5000))):
        made = F.when(n <= high, f"{low}-{high}").otherwise(made)
    return F.when(n.isNull() | (n <= 0), "unknown").otherwise(made)
