"""Fixed values of each disease: category vocabularies, term patterns, limits, weights, orderings."""

from __future__ import annotations

from ..disease import Disease
from . import bladder, breast, leukaemia, lymphoma, melanoma, ovarian, prostate

ALL: dict[str, Disease] = {m.DISEASE.name: m.DISEASE for m in (bladder, breast, leukaemia, lymphoma, melanoma, ovarian, prostate)}
