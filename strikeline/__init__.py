"""Indicator voting, strike ladders and paper-trade derivation as Spark jobs."""
