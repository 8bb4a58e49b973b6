"""stylograph: writing-style measurement of text corpora as Spark jobs."""
