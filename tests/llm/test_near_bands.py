"""Bands that would lose pairs at the threshold are refused."""

import pytest

from ledgerlens.llm.hyperminhash import NearDuplicates


def test_bands_must_reach_the_threshold():
    for percent, bands, rows in ((85, 44, 7), (80, 44, 7), (50, 100, 3)):
        NearDuplicates(percent, bands, rows)
    for percent, bands, rows in ((50, 44, 7), (85, 4, 7), (70, 44, 7)):
        with pytest.raises(ValueError, match="bands"):
            NearDuplicates(percent, bands, rows)
