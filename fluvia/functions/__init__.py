"""Expressions that workloads share; all of them stay in the JVM unless their name says otherwise."""
