"""Governed analytics as Spark jobs: metric queries, event signals, policy
checks over query logs, decision ledgers, catalog and usage analysis."""
