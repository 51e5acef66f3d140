"""Reading and writing of pairs, messages, mail and feedback."""
