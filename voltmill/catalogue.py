"""Every registered query with its oracle."""

from __future__ import annotations

from .plans import curation, kernels, trains, waveforms

QUERIES = {**trains.QUERIES, **waveforms.QUERIES, **curation.QUERIES, **kernels.QUERIES}
ORACLES = {**trains.ORACLES, **waveforms.ORACLES, **curation.ORACLES, **kernels.ORACLES}
