"""Programs over streams: each micro-batch is one run of the program."""
