"""The plan modules whose queries the repository offers."""

from sparkscape.plans import analytics, channel, corpus, extra, landscape, monitor, relations, streams, training, wide

MODULES = [training, corpus, relations, landscape, monitor, channel, analytics, extra, streams, wide]
