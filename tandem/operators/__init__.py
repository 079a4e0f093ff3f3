"""Relational operators: windowed co-occurrence, set similarity, graph tables, link resolution, exports."""
