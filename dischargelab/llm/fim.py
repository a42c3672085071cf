"""Fill-in-middle transformation as a pipeline of pyarrow.compute calls on whole batches.

The texts of a batch are split into list arrays of units (lines with their line feed). Lists are flattened with
their parents' indices; a unit's ordinal is its place less its parent's first one. Two cuts per text, taken from the
hash of its id, give every unit a role (prefix, middle, suffix). The units of one role are filtered, lists are built
again from the counts per parent, and binary_join makes one piece of each list. Element-wise joins with the markers
give the output.

Nothing is shuffled. A batch is worked on in slices of a few MB; a text is never parted, so memory is some multiple of
the longest text.

Defined cases: a null or empty text is plain and empty; a text that contains a marker is plain; a null id hashes like an
empty one; repeated ids get the same draws, so equal rows give equal results; an empty table gives no rows; columns other
than id and text are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dischargelab.llm.common import map_batches, slim, table

# The markers and draws of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50


def large(s: str) -> pa.Scalar:
    return pa.scalar(s, pa.large_string())


def units(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """All units of the texts, one after the other, and the index of each one's text."""
    lists = pc.split_pattern(texts, "\n")
    parts, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    last = pc.equal(ordinals(parents), pc.subtract(pc.list_value_length(lists), 1).take(parents))
    ended = pc.binary_join_element_wise(parts, pc.if_else(last, large(""), large("\n")), large(""))
    there = pc.not_equal(ended, "")  # what follows a final line feed is no unit
    return ended.filter(there), parents.filter(there)


def ordinals(parents: pa.Array) -> pa.Array:
    """Place of each flattened unit inside its text, from 0."""
    p = parents.to_numpy(zero_copy_only=False)
    return pa.array(np.arange(len(p)) - np.searchsorted(p, p), pa.int64())


def counts(parents: pa.Array, n: int) -> pa.Array:
    return pa.array(np.bincount(parents.to_numpy(zero_copy_only=False), minlength=n), pa.int64())


def pieces(values: pa.Array, parents: pa.Array, chosen: pa.Array, n: int) -> pa.Array:
    """The chosen units of each of n texts as one string."""
    offsets = np.r_[0, np.cumsum(counts(parents.filter(chosen), n).to_numpy())]
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values.filter(chosen))
    return pc.binary_join(lists, large(""))


def transform(texts: pa.Array, draws: list[pa.Array], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> dict[str, pa.Array]:
    """Columns n, form, prefix_chars, middle_chars and output; ``draws`` are four non-negative integers per text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    values, parents = units(texts)
    n = counts(parents, len(texts))
    rest = [pa.array(d.to_numpy() % (n.to_numpy() + 1)) for d in draws[:2]]
    first, second = pc.min_element_wise(*rest), pc.max_element_wise(*rest)
    at = ordinals(parents)
    head, tail = pc.less(at, first.take(parents)), pc.greater_equal(at, second.take(parents))
    prefix, middle, suffix = (pieces(values, parents, role, len(texts)) for role in (head, pc.invert(pc.or_(head, tail)), tail))
    marked = [pc.match_substring(texts, m) for m in (PREFIX, SUFFIX, MIDDLE)]
    drawn = pa.array(draws[2].to_numpy() % 100 >= fim_percent)
    plain = pc.or_(pc.or_(pc.equal(texts, ""), drawn), pc.or_(pc.or_(marked[0], marked[1]), marked[2]))
    spm = pa.array(draws[3].to_numpy() % 100 < spm_percent)
    psm_text = pc.binary_join_element_wise(large(PREFIX), prefix, large(SUFFIX), suffix, large(MIDDLE), middle, large(""))
    spm_text = pc.binary_join_element_wise(large(SUFFIX), suffix, large(PREFIX), prefix, large(MIDDLE), middle, large(""))
    none = pa.scalar(None, pa.int64())
    return {
        "n": n,
        "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix_chars": pc.if_else(plain, none, pc.utf8_length(prefix).cast(pa.int64())),
        "middle_chars": pc.if_else(plain, none, pc.utf8_length(middle).cast(pa.int64())),
        "output": pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text)),
    }


def restore(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that ``transform`` was given, from its outputs and forms alone."""
    output = output.cast(pa.large_string())
    plain = pc.equal(form, "plain")
    # A plain output may hold any markers; it takes no part in the splits.
    cut = pc.split_pattern_regex(pc.if_else(plain, large(f"{PREFIX}{SUFFIX}{MIDDLE}"), output), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    one, two, middle = (pc.list_element(cut, i) for i in (1, 2, 3))
    spm = pc.equal(form, "spm")
    whole = pc.binary_join_element_wise(pc.if_else(spm, two, one), middle, pc.if_else(spm, one, two), large(""))
    return pc.if_else(plain, output, whole)


def draws(id_col: str, seed: int = SEED) -> list:
    """h1 to h4: the first four 8-digit groups of the hex sha256 of seed:id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fim_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                  fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = transform(batch.column("text"), [batch.column(f"h{i}") for i in range(1, 5)], fim_percent, spm_percent)
        return pa.record_batch({"doc_id": batch.column("doc_id")} | cols | {"output": cols["output"].cast(pa.string())})

    rows = slim(docs, id_col, text_col)
    return map_batches(rows.select("doc_id", "text", *draws("doc_id", seed)), kernel,
                       "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore_documents(made: DataFrame) -> DataFrame:
    """Adds ``restored`` to (doc_id, n, form, prefix_chars, middle_chars, output)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column("restored", restore(batch.column("output"), batch.column("form")).cast(pa.string()))

    cols = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    return map_batches(made.select(*cols), kernel, "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
                                                   "output string, restored string", "output")


def op13(spark, sf_dir: str) -> DataFrame:
    both = restore_documents(fim_documents(table(spark, sf_dir, "documents")))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS p,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (
  SELECT *, len(p) - CASE WHEN p[len(p)] = '' THEN 1 ELSE 0 END AS n,
    CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j FROM u),
-- A cut after i < len(p) pieces comes behind that piece's line feed; the last piece has none.
s AS (
  SELECT *, CASE WHEN i = 0 THEN '' ELSE array_to_string(p[1:i], chr(10)) || CASE WHEN i < len(p) THEN chr(10) ELSE '' END END AS head,
    CASE WHEN j = 0 THEN '' ELSE array_to_string(p[1:j], chr(10)) || CASE WHEN j < len(p) THEN chr(10) ELSE '' END END AS upto FROM c),
r AS (
  SELECT *, substr(upto, length(head) + 1) AS middle, substr(text, length(upto) + 1) AS tail,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM s)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle
    ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM r
"""
