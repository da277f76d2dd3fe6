"""Document evidence work as Spark jobs: parse, chunk, index, retrieve, pack, cite, evaluate."""
