"""refmill: reference auditing and text-corpus processing as DataFrame -> DataFrame operators."""
