"""tiercast: conversion-panel analytics on Spark DataFrames."""

from tiercast.config import ModelParams, PanelConfig

__all__ = ["ModelParams", "PanelConfig"]
