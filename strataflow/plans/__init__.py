"""Analyses composed of operators. Each covers every stratum in one job; a selection is a filter."""
