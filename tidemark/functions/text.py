"""Column expressions over log text: trimming, clipping, character entropy and personal-data rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters a text is trimmed of at both ends.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Length of the assumed time stamp header, and of the text kept as evidence.
HEADER_CHARS = 20
EVIDENCE_CHARS = 60

# What counts as personal data or a secret. (?U) gives digits, spaces and word edges their Unicode sense.
PII_RULES = {
    "email": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "ipv4": r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "api_key": r"(?iU)(?:key|token|secret)['\"]?\s*[:=]\s*['\"]?([A-Za-z0-9\-_]{16,})",
}


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def payload_body(raw_payload: Column) -> Column:
    """The payload after its time stamp header, cut by characters whatever the header's real length."""
    return F.substring(raw_payload, HEADER_CHARS + 1, 2**31 - 1 - HEADER_CHARS)


def evidence(raw_payload: Column) -> Column:
    return F.substring(raw_payload, 1, EVIDENCE_CHARS)


def pii_hits(text: Column) -> dict[str, Column]:
    """One boolean per rule. A mail address needs an ``@``, which is cheap to look for before the regex runs."""
    hits = {name: text.rlike(rule) for name, rule in PII_RULES.items()}
    hits["email"] = F.contains(text, F.lit("@")) & hits["email"]
    return hits


def pii_count(text: Column) -> Column:
    return sum((hit.cast("bigint") for hit in pii_hits(text).values()), F.lit(0).cast("bigint"))


def _entropy_function():
    # Nested so that it travels to the executors by value; it works on whole Arrow batches, not on rows.
    def entropy_of_batch(batch):
        import numpy as np
        import pyarrow as pa

        batch = batch.cast(pa.large_string())
        rows = len(batch)
        result = np.zeros(rows)
        if rows == 0:
            return pa.array(result)
        offsets = np.frombuffer(batch.buffers()[1], dtype=np.int64)[batch.offset : batch.offset + rows + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        if last > first:
            data = np.frombuffer(batch.buffers()[2], dtype=np.uint8)[first:last]
            offsets = offsets - first
            # About a million bytes at a time bounds the memory, whatever the texts' lengths.
            begin = 0
            while begin < rows:
                end = int(np.searchsorted(offsets, offsets[begin] + 1_000_000, side="right")) - 1
                end = min(rows, max(end, begin + 1), begin + 8192)
                piece = data[offsets[begin] : offsets[end]]
                bounds = offsets[begin : end + 1] - offsets[begin]
                if piece.size and piece.max() >= 128:
                    starts = (piece & 0xC0) != 0x80
                    bounds = np.concatenate(([0], np.cumsum(starts)))[bounds]
                    points = np.frombuffer(piece.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
                    seen = np.zeros(int(points.max()) + 1, dtype=np.int64)
                    seen[points] = 1
                    kinds = int(seen.sum())
                    codes = (np.cumsum(seen) - 1)[points]
                else:
                    codes, kinds = piece.astype(np.int64), 128
                lengths = np.diff(bounds)
                group = max(1, 4_000_000 // kinds)
                for low in range(0, end - begin, group):
                    high = min(end - begin, low + group)
                    size = high - low
                    row_of_char = np.repeat(np.arange(size, dtype=np.int64), lengths[low:high])
                    counts = np.bincount(
                        row_of_char * kinds + codes[bounds[low] : bounds[high]], minlength=size * kinds
                    ).reshape(size, kinds)
                    share = counts / np.maximum(lengths[low:high], 1)[:, None]
                    bits = share * np.log2(np.where(share > 0, share, 1.0))
                    result[begin + low : begin + high] = np.abs(bits.sum(axis=1))
                begin = end
        missing = batch.is_null().to_numpy(zero_copy_only=False)
        return pa.array(result, mask=missing if missing.any() else None)

    return entropy_of_batch


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for empty text."""
    import pyarrow as pa

    function = _entropy_function()
    function.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(function, "double")(text)
