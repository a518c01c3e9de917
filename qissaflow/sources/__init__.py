"""Books, labelled texts, predictions and reports on disk; sinks; the folder that executors share."""
