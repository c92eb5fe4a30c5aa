"""Bundled operations of smart accounts: the operations of a bundle, and the transfers that each makes.

A bundle is opened in steps, one row a bundle, an operation, and a call inside it, so what is
read at each step are plain projections over bytes; only the bodies of a batch walk an array.  Arrays are as long as their calldata lets them be; a count that it can't hold is
reported, not cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.functions import abi

# fixed values: entry points and selectors of bundled operations
ENTRY_POINTS = ("0x5ff137d4b0fdcd49dca30c7cf57e578a026d2789", "0x0000000071727de22e5e9d8baf0edac6f37da032")
HANDLE_OPS, EXECUTE, EXECUTE_OP = "0x1fad948c", "0xb61d27f6", "0x51945447"
EXECUTE_BATCH, EXECUTE_BATCH_VALUE = "0x18dfb3c7", "0x47e1da2a"
TRANSFER, TRANSFER_FROM = "0xa9059cbb", "0x23b872dd"

#: Words of an operation's head, and the slot of its calldata.
HEAD_WORDS, CALL_SLOT = 11, 3


def places(data: Column, begin: Column, n: Column) -> Column:
    """0..n-1 for an array that begins at ``begin``; null where its words aren't all there, or there is none."""
    fits = (n > 0) & (begin + abi.WORD * (n + 1) <= F.length(data))
    return F.when(fits, F.sequence(F.lit(0).cast("long"), n - 1))


def user_operations(calls: DataFrame) -> DataFrame:
    """calls (to, calldata, any others) -> the others, index, sender, call (bytes), n_declared, problem: a row for
    each operation of a bundle that is sent to an entry point.

    An operation without a whole head or calldata has the problem ``operation`` and a null
    call; a bundle whose count its calldata can't hold is one row with the problem
    ``count`` and a null index.  Calls that aren't bundles give no row.
    """
    others = [c for c in calls.columns if c not in ("to", "calldata")]
    rows = calls.where(F.lower(F.trim("to")).isin(*ENTRY_POINTS)).select(*others, abi.step(abi.raw(F.col("calldata"))).alias("data"))
    data = F.col("data")
    rows = rows.where(abi.selector(data) == HANDLE_OPS).select(*others, "data", (abi.ARGUMENTS + abi.below(data, F.lit(abi.ARGUMENTS))).alias("begin"))
    rows = rows.select(*others, "data", "begin", abi.below(data, F.col("begin")).alias("n_declared"))
    rows = rows.select(*others, "data", "n_declared", (F.col("begin") + abi.WORD).alias("first"), F.explode_outer(places(data, F.col("begin"), F.col("n_declared"))).alias("i"))
    rows = rows.where("i IS NOT NULL OR n_declared IS NULL OR n_declared > 0")
    rows = rows.select(*others, "data", "n_declared", "i", (F.col("first") + abi.below(data, F.col("first") + abi.WORD * F.col("i"))).alias("base"))
    rows = rows.select(*others, "data", "n_declared", "i", "base", (F.col("base") + abi.below(data, F.col("base") + abi.WORD * CALL_SLOT)).alias("at"))
    rows = rows.select(*others, "data", "n_declared", "i", "base", "at", abi.below(data, F.col("at")).alias("size"))
    held = (F.col("base") + abi.WORD * HEAD_WORDS <= F.length(data)) & (F.col("at") + abi.WORD + F.col("size") <= F.length(data))
    call = F.when(held, F.substring(data, (F.col("at") + abi.WORD + 1).cast("int"), F.col("size").cast("int")))
    opened = abi.step(F.struct(abi.slot(data, F.col("base"), 0).alias("sender"), call.alias("call"))).alias("op")
    rows = rows.select(*others, "n_declared", F.col("i").cast("int").alias("index"), opened)
    problem = F.when(F.col("index").isNull(), "count").when(F.col("op.call").isNull(), "operation")
    return rows.select(*others, "index", abi.address_of(F.col("op.sender")).alias("sender"), F.col("op.call").alias("call"), "n_declared", problem.alias("problem"))


def inner_transfers(operations: DataFrame) -> DataFrame:
    """operations (sender, call, any others) -> the others, place (of the call in its batch), src, dst, token, amount
    (decimal digits, all of 256 bits): token transfers inside execute and executeBatch (token:
    the contract called), the value that they send where there is none (token ''), and
    bare transfers (token '').  A batch of which a part can't be read gives nothing."""
    others = [c for c in operations.columns if c not in ("sender", "call")]
    call, code = F.col("call"), abi.selector(F.col("call"))
    batch, valued = code.isin(EXECUTE_BATCH, EXECUTE_BATCH_VALUE), code == EXECUTE_BATCH_VALUE
    kept = [*others, "sender", "call"]
    rows = operations.where(code.isin(EXECUTE, EXECUTE_OP, EXECUTE_BATCH, EXECUTE_BATCH_VALUE, TRANSFER, TRANSFER_FROM))
    offset = lambda n: abi.ARGUMENTS + abi.below(call, F.lit(abi.ARGUMENTS + abi.WORD * n))
    single = code.isin(EXECUTE, EXECUTE_OP)
    rows = rows.select(*kept, F.when(batch, offset(0)).alias("targets"), F.when(valued, offset(1)).alias("values"), F.when(valued, offset(2)).when(batch, offset(1)).alias("bodies"), F.when(single, offset(2)).alias("at"))
    count = lambda c: abi.below(call, F.col(c))
    rows = rows.select(*kept, "targets", "values", "bodies", "at", count("targets").alias("n"), F.coalesce(count("values"), F.lit(0)).alias("n_values"), count("bodies").alias("n_bodies"))
    first = F.col("bodies") + abi.WORD
    # where the body of each call begins; -1 for one without
    begins = F.transform(places(call, F.col("targets"), F.col("n")), lambda i: F.when(i < F.col("n_bodies"), first + abi.below(call, first + abi.WORD * i)).otherwise(F.lit(-1).cast("long")))
    rows = rows.select(*kept, "targets", "values", "n_values", F.when(batch, begins).when(single, F.array("at")).alias("begins"))
    rows = rows.select(*kept, "targets", "values", "n_values", "begins", F.transform("begins", lambda p: F.when(p < 0, F.lit(0).cast("long")).otherwise(abi.below(call, p))).alias("sizes"))
    read = lambda p, n: F.when(p < 0, F.lit(b"")).when(p + abi.WORD + n <= F.length(call), F.substring(call, (p + abi.WORD + 1).cast("int"), n.cast("int")))
    rows = rows.select(*kept, "targets", "values", "n_values", abi.step(F.when(batch | single, F.zip_with("begins", "sizes", read)).otherwise(F.array(call))).alias("parts"))
    rows = rows.where(F.forall("parts", lambda x: x.isNotNull())).select(*kept, "targets", "values", "n_values", F.posexplode("parts").alias("place", "body"))
    nth = abi.WORD * (F.col("place") + 1)
    target = F.when(batch, abi.word(call, F.col("targets") + nth)).when(single, abi.word(call, abi.ARGUMENTS))
    value = F.when(F.col("place") < F.col("n_values"), abi.word(call, F.col("values") + nth)).when(single, abi.word(call, abi.ARGUMENTS + abi.WORD))
    rows = rows.select(*others, "place", "sender", target.alias("target"), value.alias("value"), "body")

    body, inner, target = F.col("body"), abi.selector(F.col("body")), abi.address_of(F.col("target"))
    argument = lambda n: abi.slot(body, abi.ARGUMENTS, n)
    plain, taken = (inner == TRANSFER) & (F.length(body) >= abi.ARGUMENTS + 2 * abi.WORD), (inner == TRANSFER_FROM) & (F.length(body) >= abi.ARGUMENTS + 3 * abi.WORD)
    paid = F.col("value").isNotNull() & (F.col("value") != F.lit(bytes(32)))
    kind = F.when(plain, "transfer").when(taken, "transferFrom").when(paid, "value")
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    pick = lambda a, b, c: F.when(F.col("kind") == "transfer", a).when(F.col("kind") == "transferFrom", b).otherwise(c)
    made = rows.select(
        *others, "place", pick(F.col("sender"), abi.address_of(argument(0)), F.col("sender")).alias("src"), pick(abi.address_of(argument(0)), abi.address_of(argument(1)), target).alias("dst"),
        F.when(F.col("kind") == "value", "").otherwise(F.coalesce(target, F.lit(""))).alias("token"), pick(argument(1), argument(2), F.col("value")).alias("amount"),
    )
    return abi.numbered(made, "amount")
