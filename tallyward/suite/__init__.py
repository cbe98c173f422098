"""Every operator as a query over the test tables, most with a SQL twin."""

from tallyward.suite import catalogs, corpora, events, governance, layouts, ledger, metrics, rules, streams, usage

SUITES = [
    module.SUITE
    for module in (metrics, governance, events, layouts, rules, ledger, catalogs, usage, corpora, streams)
]
