"""All registered queries of this package."""

from larder.llm import alignment, divergence, jaccard, pieces, pii, pitman_yor, repeats, resampling, secret_scan, shards, site_quality, tiling, toxicity  # noqa: F401  (registers its query)
from larder.llm.common import ORACLES, QUERIES  # noqa: F401
