"""Lexers with resumable states, bracket summaries, and grammars of the languages whose files are checked."""
