"""Column functions: text, references, titles, dates, vectors; and the few Python UDFs."""
