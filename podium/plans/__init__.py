"""Compositions: dataset builders, model pipelines, studies, prediction."""
