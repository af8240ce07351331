"""Content keys: a tile's identity as one digest, a layer's serving version as another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tiles import col

# Fixed value: digests of different key schemes never collide because this text is hashed first.
KEY_DOMAIN = "raster tile-key v1"


def _reverse_bytes(hex_text: Column, width: int) -> Column:
    pairs = [F.substring(hex_text, 2 * width - 2 * i - 1, 2) for i in range(width)]
    return F.concat(*pairs)


def little_endian(value: Column, width: int) -> Column:
    """An unsigned integer as ``width`` little-endian bytes."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * width, "0")
    return F.unhex(_reverse_bytes(digits, width))


def _field(data: Column, length: int | None = None) -> Column:
    """A field preceded by its byte length as eight little-endian bytes."""
    if length is not None:
        return F.concat(F.unhex(F.lit(length.to_bytes(8, "little").hex())), data)
    # a text is far below 4 GiB, so the upper four length bytes are zero
    return F.concat(little_endian(F.octet_length(data).cast("long"), 4), F.unhex(F.lit("00000000")), data)


def tile_key_hash(layer, version, plan_json, tms, z, x, y, tile_size, domain: str = KEY_DOMAIN) -> Column:
    """SHA-256 over length-prefixed fields; equal keys mean equal tiles."""
    texts = [F.lit(domain), *[col(c) for c in (layer, version, plan_json, tms)]]
    fields = [_field(t.cast("binary")) for t in texts]
    fields.append(_field(little_endian(col(z), 1), 1))
    fields += [_field(little_endian(col(c), 4), 4) for c in (x, y, tile_size)]
    return F.sha2(F.concat(*fields), 256)


def layer_version(granule, plan_json) -> Column:
    """``granule@digest(plan)``, or the digest alone when no granule backs the layer."""
    digest = F.sha2(col(plan_json).cast("binary"), 256)
    granule = col(granule) if granule is not None else F.lit(None).cast("string")
    return F.concat(F.coalesce(F.concat(granule.cast("string"), F.lit("@")), F.lit("")), digest)
