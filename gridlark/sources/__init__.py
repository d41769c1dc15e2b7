"""Where rows come from and go to: topics, feeds, snapshots, tables, sinks."""
