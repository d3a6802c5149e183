"""Programs of the tape machine: expansion, execution, training rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.windows import OUTPUT_TAG

# The macro letters and what each stands for.
MACROS = {
    "Z": "[-]",
    "R": "[->+<]",
    "L": "[->+++<]",
    "N": "[-<->]",
    "C": "[->+>+<<]",
    "G": "[>]",
    "H": "[<]",
    "W": "[[-]>+<]",
    "V": "[.>]",
    "X": "[-]++++++++++++++++",
}


def expand(column: str):
    """A program's code: without its tag byte and bytes that aren't ASCII, up to the first
    ``F``, macros replaced. No macro holds another's letter, so their order is free."""
    code = F.expr(f"substring_index(regexp_replace(decode(substring(`{column}`, 2), 'ISO-8859-1'), '[^\\\\x00-\\\\x7F]', ''), 'F', 1)")
    for letter, body in MACROS.items():
        code = F.replace(code, F.lit(letter), F.lit(body))
    return code


ADD, MOVE, OPEN, CLOSE, WRITE, DRAW, NOTHING = range(7)


def compile_code(code: bytes) -> list[tuple[int, int, int]]:
    """(operation, argument, length) by letter: runs of ``+ -`` and of ``> <`` become one
    operation with its sum; a bracket's argument is its partner's operation, or its own place
    where it has none."""
    ops: list[tuple[int, int, int]] = []
    kinds = {ord("+"): (ADD, 1), ord("-"): (ADD, -1), ord(">"): (MOVE, 1), ord("<"): (MOVE, -1), ord("["): (OPEN, 0), ord("]"): (CLOSE, 0), ord("."): (WRITE, 0), ord(","): (DRAW, 0)}
    for c in code:
        kind, by = kinds.get(c, (NOTHING, 0))
        if ops and kind in (ADD, MOVE, NOTHING) and ops[-1][0] == kind:
            ops[-1] = kind, ops[-1][1] + by, ops[-1][2] + 1
        else:
            ops.append((kind, by, 1))
    waiting = []
    for at, (kind, _, _) in enumerate(ops):
        if kind in (OPEN, CLOSE):
            ops[at] = kind, at, 1
        if kind == OPEN:
            waiting.append(at)
        elif kind == CLOSE and waiting:
            other = waiting.pop()
            ops[at], ops[other] = (CLOSE, other, 1), (OPEN, at, 1)
    return ops


def execute(code: bytes, draws: np.random.Generator | None, max_steps: int, tape_length: int, output_length: int, modulus: int = 256) -> tuple[bytes, int]:
    """What the code writes, and its steps. Every byte fetched costs a step, also one that
    means nothing; a bracket without a partner does nothing. Values of a modulus over 256 are
    written as eight bytes each, the lowest first."""
    ops, tape, out = compile_code(code), [0] * tape_length, []
    place = steps = next_ = 0
    while next_ < len(ops) and steps < max_steps and len(out) < output_length:
        kind, by, size = ops[next_]
        next_ += 1
        steps += size
        if kind == ADD:
            tape[place] = (tape[place] + by) % modulus
        elif kind == MOVE:
            place = (place + by) % tape_length
        elif kind == WRITE:
            out.append(tape[place])
        elif kind == DRAW:
            tape[place] = int(draws.integers(0, 1 << 32, dtype=np.uint32)) % modulus
        elif (kind == OPEN) != bool(tape[place]) and kind != NOTHING:
            next_ = by + 1
    return np.array(out, np.uint8 if modulus <= 256 else "<i8").tobytes(), min(steps, max_steps)


def run(programs: DataFrame, max_steps: int = 1 << 14, tape_length: int = 1024, output_length: int = 4095, modulus: int = 256, seed: int = 0) -> DataFrame:
    """``id, program`` (tagged bytes) to ``id, code, output, n_written, steps``. A program's
    random input depends on the seed and its id alone, so no partitioning changes results."""
    base = programs.select("id", expand("program").alias("code"))

    def kernel(batches):
        for b in batches:
            rows = []
            for i, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                draws = np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(i,)))
                out, steps = execute(code.encode("ascii"), draws, max_steps, tape_length, output_length, modulus)
                rows.append((i, code, out, len(out) if modulus <= 256 else len(out) // 8, steps))
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["id", "code", "output", "n_written", "steps"])

    return base.mapInArrow(kernel, "id long, code string, output binary, n_written int, steps long")


def training_rows(runs: DataFrame, length: int = 4096) -> DataFrame:
    """``O``, the output, zeros up to ``length`` bytes."""
    fill = F.expr(f"unhex(repeat('00', {length} - 1 - octet_length(output)))")
    return runs.select("id", F.concat(F.lit(bytearray(OUTPUT_TAG)), F.col("output"), fill).alias("row"), "n_written")
